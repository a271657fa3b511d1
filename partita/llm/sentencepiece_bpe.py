"""SentencePiece BPE encoding by a merge-type prefix table.

Byte-pair merging gives each prefix of a text one encoding, so each prefix has one last token. A token that ends at a
position is that last token when it is its own encoding and goes with the last token of the prefix before it: the two,
merged on their own, stay apart. One pass over an automaton's matches fills the table of last tokens, and the ids are then
read off backwards from the end. The pair tests are exact merges of the two tokens' characters and are kept in a table.

The text is normalised by the library. No piece goes on from a visible character into the space mark, so words are encoded
one by one and kept in a table of bounded size, which words that go on being met never leave; a model with other pieces is
encoded text by text.
Characters without a piece become byte tokens. Models with user-defined or unused pieces or without byte pieces are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import slices, table

SPACE = "▁"
#: Bytes that the table of words may take in each worker, and entries of that of token pairs; a full table of pairs starts anew.
WORD_BYTES, PAIRS = 64 << 20, 1 << 18
#: Bytes of text that are encoded before a batch is handed on; a longer text is a batch by itself.
SLICE = 1 << 22
#: A token, or a character that is none, fits in so many bits.
BITS = 22


USER_DEFINED = 4


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (raw[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if raw[at - 1] < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message's fields."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        if tag & 7 == 0:
            value, at = _varint(raw, at)
        else:
            size, at = _varint(raw, at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


def piece_types(model: bytes) -> list[int]:
    """The type of each piece (field 1 of the model, field 3 of a piece; 1, normal, where it is not given)."""
    return [next((v for n, v in _fields(piece) if n == 3), 1) for number, piece in _fields(model) if number == 1]


class Words(dict):
    """Packed ids by word. Half of WORD_BYTES is for the words met since the table was last full, half for those met before that."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.before, self.bytes = make, {}, 0

    def __missing__(self, w: str) -> bytes:
        ids = self.before.get(w)
        if ids is None:
            ids = self.make(w)
        if len(w) <= 64:
            if self.bytes >= WORD_BYTES // 2:
                self.before = None
                self.before, self.bytes = dict(self), 0
                self.clear()
            self[w] = ids
            # An entry of the dictionary, with its room to grow, and the heads of the two strings.
            self.bytes += 160 + 2 * len(w) + len(ids)
        return ids


class PrefixTableEncoder:
    def __init__(self, model_file: str):
        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        kinds = piece_types(sp.serialized_model_proto())
        self.bytes = [-1] * 256
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
            elif sp.is_unused(i) or kinds[i] == USER_DEFINED:
                raise ValueError("models with unused or user-defined pieces are not supported")
            elif not sp.is_control(i) and not sp.is_unknown(i):
                self.ids[p], self.score[p] = i, sp.get_score(i)
        if -1 in self.bytes:
            raise ValueError("models without byte pieces are not supported")
        # Characters within pieces that are no pieces themselves take part in merges as symbols without an id.
        self.tokens = dict(self.ids)
        for c in {c for p in self.ids for c in p} - set(self.ids):
            self.tokens[c] = n + ord(c)
        self.name = {i: p for p, i in self.tokens.items()}
        self.packed = [struct.pack("<i", i) for i in range(n)]
        self.by_words = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        breaks = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))
        self.cutter = re.compile(f"{SPACE}*[^{SPACE}{breaks}]+|{SPACE}+|[{breaks}]" if breaks else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.automaton = ahocorasick.Automaton()
        # Per token its own merges in order: (key, last symbol then) and (key, first symbol then); small keys go first.
        self.right: dict[int, list[tuple[float, str]]] = {}
        self.left: dict[int, list[tuple[float, str]]] = {}
        for p, i in self.tokens.items():
            if self._merged(p, steps := []) == [p]:
                self.automaton.add_word(p, (i, len(p)))
                self.right[i] = [(k, last) for k, _, last in steps]
                self.left[i] = [(k, first) for k, first, _ in steps]
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words = Words(lambda w: self._word(w))

    def _merged(self, s: str, steps: list | None = None) -> list[str]:
        """The library's merging, for short strings: best score first, then leftmost. steps gets (key, first, last symbol)."""
        sym, nxt, prv = list(s), list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and nxt[i] < len(s) and (w := sym[i] + sym[nxt[i]]) in self.score:
                heapq.heappush(heap, (-self.score[w], i, nxt[i], w))

        for i in range(len(s) - 1):
            offer(i)
        while heap:
            key, i, j, w = heapq.heappop(heap)
            if not sym[i] or not sym[j] or nxt[i] != j or sym[i] + sym[j] != w:
                continue
            sym[i], sym[j], nxt[i] = w, "", nxt[j]
            if nxt[i] < len(s):
                prv[nxt[i]] = i
            offer(prv[i])
            offer(i)
            if steps is not None:
                steps.append((key, sym[0], next(x for x in reversed(sym) if x)))
        return [x for x in sym if x]

    def _together(self, a: int, b: int) -> bool:
        """Whether token b can follow token a, for the table of pairs."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        ok = self.pairs[a << BITS | b] = self._apart(self.name[a][-1], self.right[a], self.name[b][0], self.left[b])
        return ok

    def _apart(self, x: str, ahead: list, y: str, behind: list) -> bool:
        """Plays the merges of two neighbours side by side: False if one across their border comes first at any time.

        x, y: the symbols at the border. Of equal keys the leftmost goes first: left token, border, right token.
        """
        i = j = 0
        while True:
            cross = self.score.get(x + y)
            while True:
                ka = ahead[i][0] if i < len(ahead) else math.inf
                kb = behind[j][0] if j < len(behind) else math.inf
                if cross is not None and -cross < ka and -cross <= kb:
                    return False
                if ka == kb == math.inf:
                    return True
                if ka <= kb:
                    old, x, i = x, ahead[i][1], i + 1
                    if x != old:
                        break
                else:
                    old, y, j = y, behind[j][1], j + 1
                    if y != old:
                        break

    def _word(self, s: str) -> bytes:
        """Packed ids of a piece of normalised text."""
        last = [-1] * (len(s) + 1)
        known, together = self.pairs.get, self._together
        for end, (tok, n) in self.automaton.iter(s):
            if last[end + 1] < 0:
                before = last[end + 1 - n]
                # Nothing merges with a character that is in no piece, nor with the start of the text.
                if before >= 0:
                    ok = known(before << BITS | tok)
                    if not (together(before, tok) if ok is None else ok):
                        continue
                last[end + 1] = tok
        out, i, packed, name = [], len(s), self.packed, self.name
        while i:
            tok = last[i]
            if 0 <= tok < len(packed):
                out.append(packed[tok])
                i -= len(name[tok])
            else:
                out += [packed[self.bytes[b]] for b in reversed(s[i - 1].encode())]
                i -= 1
        out.reverse()
        return b"".join(out)

    def encode_packed(self, text: str | None) -> bytes:
        """Ids without begin and end as little-endian 32-bit integers; None: those of the empty text."""
        if not text:
            return b""
        s = self.sp.normalize(text)
        return b"".join(map(self.words.__getitem__, self.cutter.findall(s))) if self.by_words else self._word(s)

    def encode(self, text: str | None) -> list[int]:
        """Ids without begin and end; None: those of the empty text."""
        return np.frombuffer(self.encode_packed(text), "<i4").tolist()

    def encode_whole(self, text: str | None) -> bytes:
        """encode_packed with begin and end."""
        return b"".join((struct.pack("<i", self.bos), self.encode_packed(text), struct.pack("<i", self.eos)))

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)

    def decode_packed(self, ids: bytes) -> str:
        return self.sp.decode(np.frombuffer(ids, "<i4").tolist())


@lru_cache(maxsize=2)
def encoder(model_file: str) -> PrefixTableEncoder:
    return PrefixTableEncoder(model_file)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _over(model_file: str, make) -> Callable:
    """mapInArrow function over columns and, last, the text; make(encoder, texts) -> arrays. Batches are cut by bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_file)
        for rb in batches:
            for start, end in slices(rb.column("text"), SLICE):
                part = rb.slice(start, end - start)
                made = make(enc, part.column("text").to_pylist())
                names = [*part.schema.names[:-1], *made]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made.values()], names)

    return run


def _ids_and_text(enc: PrefixTableEncoder, texts: list[str | None]) -> dict[str, pa.Array]:
    packed = [enc.encode_whole(t) for t in texts]
    decoded = pa.array((enc.decode_packed(x) for x in packed), pa.string(), size=len(packed))
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
    ids = pa.array(np.frombuffer(b"".join(packed), "<i4"))
    return {"ids": pa.ListArray.from_arrays(pa.array(offsets), ids), "decoded": decoded}


def encode_texts(df: DataFrame, text: str = "text", out: str = "ids", model_file: str | None = None) -> DataFrame:
    """df with array<int> ids of each whole text, begin and end ids included, and decoded string.

    Null or empty text: begin and end only, decoded to the empty string. Columns named like the results are replaced, any other
    names stay. Repeated rows are encoded each; no rows: no rows. Texts are held a few megabytes at a time, a longer one by itself
    and whole: a worker needs some 20 bytes a character of the longest text.
    """
    rest = [f for f in df.schema.fields if f.name not in (out, "decoded")]
    named = [StructField(f"c{i}", f.dataType) for i, f in enumerate(rest)]
    base = df.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(rest)], F.col(f"`{text}`").alias("text"))
    schema = StructType([*named, StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])
    got = base.mapInArrow(_over(model_file or default_model(), _ids_and_text), schema)
    return got.toDF(*[f.name for f in rest], out, "decoded")


def _digests(enc: PrefixTableEncoder, texts: list[str | None]) -> dict[str, pa.Array]:
    n, ids_sha, text_sha = [], [], []
    for t in texts:
        ids = enc.encode_whole(t)
        n.append(len(ids) // 4)
        ids_sha.append(hashlib.sha256(ids).hexdigest())
        text_sha.append(hashlib.sha256(enc.decode_packed(ids).encode()).hexdigest())
    return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}


def token_digests(df: DataFrame, text: str = "text", model_file: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: as encode_texts, with digests made where the ids are made."""
    base = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return base.mapInArrow(_over(model_file or default_model(), _digests), schema)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return token_digests(table(spark, sf_dir, "documents"))
