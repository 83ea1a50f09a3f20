"""The views as Spark plans them against their one definition, and what their plans exchange."""

from __future__ import annotations

import contextlib
import io
import time
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import stowage.plans.backup
import stowage.plans.ledger  # noqa: F401
from stowage.operators import discovery
from stowage.plans.discovery import _discovered
from stowage.plans.registry import QUERIES
from stowage.session import settle, shared_dir
from stowage.sources.views import BASE, PLANNED, VIEWS, Tables
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The small tables with documents, parts and order lines that come twice, and lines without an order, a part or a quantity."""
    folder = str(tmp_path_factory.mktemp("odd"))
    for name in BASE:
        df = spark.read.parquet(f"{SMALL}/{name}.parquet")
        twice = {"documents": "doc_id % 3 = 0", "part": "p_partkey % 5 = 0", "lineitem": "l_orderkey % 4 = 0"}.get(name)
        if twice:
            df = df.union(df.filter(twice))
        if name == "lineitem":
            lost = [F.when(F.col("l_suppkey") % 7 == k, None).otherwise(F.col(c)).alias(c) for k, c in enumerate(("l_orderkey", "l_partkey", "l_quantity"))]
            df = df.union(df.filter("l_suppkey % 7 < 3").withColumns(dict(zip(("l_orderkey", "l_partkey", "l_quantity"), lost))))
        df.write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", [*(v for v in PLANNED if v in VIEWS), "index_documents"])
def test_planned_views_have_the_rows_of_their_definition(spark, odd, name):
    got, said = getattr(Tables(spark, odd), name), getattr(Tables(spark, odd, planned=False), name)
    assert got.schema.simpleString() == said.schema.simpleString()
    assert said.count() > 0
    assert got.exceptAll(said).count() == said.exceptAll(got).count() == 0


def exchanges(df):
    """The lines of a plan that deal rows out anew, each with what is dealt."""
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return [block for block in text.getvalue().split("\n\n") if ") Exchange" in block.split("\n")[0]]


def test_index_entries_travel_once(spark):
    """Paths are dealt out with the records and once with the parts, whose documents are put together where they lie; texts never are."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = exchanges(Tables(spark, SMALL).index_documents)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not any("text#" in x for x in dealt)
    assert sum("local_path" in x for x in dealt) <= 2 and sum("l_partkey" in x for x in dealt) == 2


@pytest.fixture
def unbroadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_members_of_an_index_travel_once(unbroadcast):
    """From where an archive's entries are to its document: one deal, by the archive."""
    dealt = exchanges(QUERIES["build_index"](unbroadcast, SMALL))
    assert sum("entry_size" in x or "paths" in x for x in dealt) == 1


def test_entries_to_verify_travel_once_and_by_digest(unbroadcast):
    dealt = exchanges(QUERIES["verify_shallow"](unbroadcast, SMALL))
    assert not any("entry_key" in x for x in dealt) and sum("name#" in x for x in dealt) == 1


def test_entries_are_discovered_narrow(unbroadcast):
    """What is dealt by content holds no field of an entry that nothing reads, and is let go of before the listing is met."""
    parsed = discovery.entries(discovery.parse_index(Tables(unbroadcast, SMALL).index_documents))
    assert "paths_enc" in parsed.schema["entry"].dataType.simpleString()
    found = _discovered(Tables(unbroadcast, SMALL))
    assert not any("index_documents" in x or "l_orderkey" in x for x in exchanges(found.parts))
    folder = Path(shared_dir(unbroadcast))
    named = sorted(folder.glob("named-*"), key=lambda p: p.stat().st_mtime)[-1]
    assert "paths_enc" not in unbroadcast.read.parquet(str(named)).schema["entry"].dataType.simpleString()


def test_settled_rows_let_go_of_the_shuffles_before(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {b for b in str(disk.getAllBlocks().mkString(",")).split(",") if b.startswith("shuffle_")}
    before = held()
    spark.range(1000).repartition(4, "id").write.parquet(f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}")
    first = held() - before
    assert first
    time.sleep(1)
    for name in ("some", "more"):
        settle(spark.range(10), name)
    for _ in range(20):
        if not first & held():
            break
        time.sleep(0.5)
    assert not first & held()
