"""Operator 9: SentencePiece encoding and decoding of BPE models with a prefix table.

A merge-type BPE encoding has the property that each prefix of a text has one encoding, that of the text's own tokens
where
they end there, so it is enough to know each prefix's last token. An Aho-Corasick automaton gives the tokens that end
at a position; the
last token of the prefix is the one that is compatible with the last token of the prefix before it: a pair is
compatible if
encoding its two texts together gives the pair again. Ids are then recovered from the end backwards. No merge queue
runs over
the text, so the work is linear in its length.

Between two characters that stand side by side in no piece nothing ever merges. So texts fall into segments at such
places, which are
encoded on their own; both the words between space marks and their segments are kept in bounded tables by each Python
worker.
Runs of space marks all have one score, the worst, so they merge last and from the left: a stack of the lengths merged
so far gives them. The last
mark of a run belongs to the following word if that word takes it.

Decoding maps ids to pieces, bytes of fallback pieces to characters, marks to spaces, and drops the space that encoding
puts
first. Defined cases: null and empty texts have the end id alone and decode to the empty text; a null id is kept;
repeated rows and ids are
rows of their own; a text of any length is encoded whole, in time linear in it; an empty table gives no rows. Only id
and text are read, so extra columns can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from stowage.llm.common import text_bytes

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
FOREIGN = 1 << 21  # from here on: a character that is no piece
#: The most words, segments and pairs that a worker keeps, and the longest of them.
KEPT = 400_000
LONGEST_KEPT = 64


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, model_file: bytes) -> None:
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(model_file)
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != train.BPE or not train.byte_fallback or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError(
                "only BPE models with byte fallback, identity normalisation and a leading mark are handled"
            )
        self.pieces = [p.piece for p in model.pieces]
        self.bytes_from = next(i for i, p in enumerate(model.pieces) if p.type == BYTE)
        self.byte_of = {i: int(p.piece[3:-1], 16) for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.end_id = next(i for i, p in enumerate(model.pieces) if p.type == CONTROL and p.piece == train.eos_piece)
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.runs = {len(p): i for p, i in self.id_of.items() if p.strip(MARK) == ""}
        others = [x for p, x in self.score.items() if len(p) > 1 and p.strip(MARK)]
        worst = {self.score[MARK * n] for n in self.runs if n > 1}
        if any(
            MARK in p[1:] and p.strip(MARK) for p in self.id_of
        ) or len(worst) > 1 or worst and others and max(worst) >= min(others) or 1 not in self.runs:
            raise ValueError("a piece spans a space mark, or runs of marks don't merge last")
        for n in self.runs:
            if n > 1:
                del self.score[MARK * n]  # they are merged by rule
        self.compatible: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.score:
            if len(p) == 1 or self.merged(p) == [p]:
                self.automaton.add_word(p, (self.id_of[p], len(p)))
        self.automaton.make_automaton()
        self.neighbours = {a + b for p in self.id_of for a, b in zip(p, p[1:])}
        lines = any("\n" in p for p in self.neighbours)
        # a word: marks and what follows up to the next mark; a line end is a word of its own if no piece joins it to
        # anything
        self.word = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if lines else f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
        self.words = _Words(self)
        self.segments = _Segments(self)

    def merged(self, text: str) -> list[str]:
        """BPE by its definition, for texts of two pieces at most: the best-scored neighbours merge, the left ones
        first.
        """
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _text(self, token: int) -> str:
        return chr(token - FOREIGN) if token >= FOREIGN else self.pieces[token]

    def _fits(self, left: int, right: int) -> bool:
        key = left << 22 | right
        known = self.compatible.get(key)
        if known is None:
            a, b = self._text(left), self._text(right)
            known = self.merged(a + b) == [a, b]
            if len(self.compatible) < KEPT:
                self.compatible[key] = known
        return known

    def tokens(self, text: str) -> list[int]:
        """The tokens of a text without runs of marks: the prefix table, then back from its end."""
        n = len(text)
        last = [-1] * (n + 1)  # the last token of each prefix
        size = [0] * (n + 1)
        fits = self.compatible.get
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue  # there is one such token only
            begin = end - length
            if begin:
                before = last[begin]
                if before < 0:
                    before = last[begin] = FOREIGN + ord(text[begin - 1])
                    size[begin] = 1
                ok = fits(before << 22 | token)
                if ok is None:
                    ok = self._fits(before, token)
                if not ok:
                    continue
            last[end], size[end] = token, length
        out, at = [], n
        while at:
            if last[at] < 0:  # no piece ends here: a character of its own
                last[at], size[at] = FOREIGN + ord(text[at - 1]), 1
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def run(self, n: int) -> list[int]:
        """The ids of n space marks that nothing else takes: of equal scores the leftmost pair merges first."""
        stack: list[int] = []
        for _ in range(n):
            stack.append(1)
            while len(stack) > 1 and stack[-2] + stack[-1] in self.runs:
                stack[-2:] = [stack[-2] + stack[-1]]
        return [self.runs[k] for k in stack]

    def encode_word(self, word: str) -> list[int]:
        """The ids of space marks and the characters that follow them."""
        body = word.lstrip(MARK)
        marks = len(word) - len(body)
        if not body:
            return self.run(marks)
        text = MARK + body if marks else body
        at = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.neighbours]
        found = [i for a, b in zip([0, *at], [*at, len(text)]) for i in self.segments[text[a:b]]]
        if marks < 2:
            return found
        own = found[0] == self.runs[1]  # the word doesn't take its mark
        return self.run(marks if own else marks - 1) + found[own:]

    def encode_segment(self, segment: str) -> list[int]:
        out = []
        for token in self.tokens(segment):
            out += [token] if token < FOREIGN else [
                self.bytes_from + b for b in chr(token - FOREIGN).encode("utf-8", "surrogatepass")
            ]
        return out

    def decode_ids(self, ids: list[int]) -> str:
        """The text of ids, without the drop of the first space."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            out.append(self.pieces[i])
        return ("".join(out) + held.decode("utf-8", "replace")).replace(MARK, " ")

    def split(self, text: str) -> list[str]:
        return self.word.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [int(i) for w in self.split(text) for i in self.words[w][0].split()] + [self.end_id]

    def encode_text(self, text: str) -> tuple[int, str, str]:
        """(number of ids, decimal ids joined by a space, decoded text)."""
        parts = list(map(self.words.__getitem__, self.split(text)))
        ids = " ".join([*(p[0] for p in parts), str(self.end_id)])
        return ids.count(" ") + 1, ids, "".join([p[1] for p in parts])[1:]


class _Words(dict):
    """(ids as text, decoded text) of each word. Bounded; what isn't kept is made again."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> tuple[str, str]:
        ids = self.codec.encode_word(word)
        made = " ".join(map(str, ids)), self.codec.decode_ids(ids)
        if len(word) <= LONGEST_KEPT and len(self) < KEPT:
            self[word] = made
        return made


class _Segments(dict):
    """The ids of each segment. Bounded as well."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, segment: str) -> list[int]:
        ids = self.codec.encode_segment(segment)
        if len(segment) <= LONGEST_KEPT and len(self) < KEPT:
            self[segment] = ids
        return ids


_CODECS: dict[str, Codec] = {}


def codec(model_file: bytes) -> Codec:
    key = hashlib.md5(model_file).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(model_file)
    return _CODECS[key]


def encode_documents(df: DataFrame, id_col: str, text_col: str, model: str, with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded). model: a file on the driver; its bytes go to the
    executors.
    """
    with open(model, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            n, ids_sha, text_sha, ids_out, texts = [], [], [], [], []
            for text in batch.column(1):
                count, ids, decoded = own.encode_text(text.as_py().decode("utf-8", "replace"))
                n.append(count)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest())
                if with_ids:
                    ids_out.append([int(i) for i in ids.split()])
                    texts.append(decoded)
            columns = [
                batch.column(0),
                pa.array(n, pa.int64()),
                pa.array(ids_sha, pa.string()),
                pa.array(text_sha, pa.string()),
            ]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_bytes(text_col).alias("_text")).mapInArrow(
        run,
        f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids,
    )
