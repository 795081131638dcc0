"""Encode and decode with a merge-type (BPE) sentencepiece model, without the library on the hot path.

A merge-type encoder repeats the best merge until none is left. Two neighbouring tokens of its result are always the result for
the two tokens' text alone (they are compatible), and a chain of compatible tokens is always the encoder's result; so every
prefix of a text has exactly one possible last token. The table of these last tokens is filled from left to right: an automaton
over the vocabulary lists the pieces that end at a position, and the one whose predecessor (the last token of the shorter
prefix) is compatible with it is stored. Reading the table backwards gives the ids. This takes time in proportion to the length.

No piece of the model holds a space mark after another character, nor a line feed beside others, so texts are cut there first and each distinct
chunk is encoded once per worker. Where a model breaks that rule, whole texts are encoded uncut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = "▁"
UNKNOWN_SURFACE = " ⁇ "


class MergePrefixTable:
    """The tables of one model and the encoder and decoder over them."""

    def __init__(self, model: str, keep: int = 150_000):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.name != "identity" or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("needs a merge-type model with the identity normaliser")
        kinds = {k: i for k, i in pb.ModelProto.SentencePiece.Type.items()}
        if any(p.type in (kinds["USER_DEFINED"], kinds["UNUSED"]) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not handled")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.pieces = [p.piece for p in proto.pieces]
        self.kind = [p.type for p in proto.pieces]
        self.normal, self.byte, self.unknown, self.control = kinds["NORMAL"], kinds["BYTE"], kinds["UNKNOWN"], kinds["CONTROL"]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == self.normal}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == self.normal}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == self.byte}
        self.unk = next(i for i, p in enumerate(proto.pieces) if p.type == self.unknown)
        self.end = self.pieces.index("</s>")
        self.unk_surface = proto.trainer_spec.unk_surface if proto.trainer_spec.HasField("unk_surface") else UNKNOWN_SURFACE
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        cut_ok = not any("\n" in p and len(p) > 1 or any(a != SPACE and b == SPACE for a, b in zip(p, p[1:], strict=False)) for p in self.ids)
        self.chunks = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall if cut_ok else lambda text: [text] if text else []
        self.fits: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.odd = False
        self.keep = keep

    def merged(self, text: str) -> list[str]:
        """The encoder's own rule, for the short texts of pair tests: the best-scored merge first, the leftmost of equals."""
        parts, get, none = list(text), self.score.get, float("-inf")
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) > none:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether left and right stay as they are when their joint text is encoded; with left empty, whether right does."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= 3 * self.keep:
                self.fits.clear()
            known = self.fits[key] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def tokens(self, text: str) -> list[str]:
        """Pieces, and single characters that are none, of a text whose spaces are escaped."""
        n = len(text)
        last = [""] * (n + 1)
        fits, compatible = self.fits.get, self.compatible
        for end, piece in self.automaton.iter(text):
            j = end + 1
            if last[j]:
                continue
            i = j - len(piece)
            before = last[i]
            if not before and i:
                before = last[i] = text[i - 1]  # a character that ends no token is no piece and joins no merge
            ok = fits((before, piece))
            if ok or ok is None and compatible(before, piece):
                last[j] = piece
        out, j = [], n
        while j:
            token = last[j] or text[j - 1]
            out.append(token)
            j -= len(token)
        out.reverse()
        return out

    def chunk_ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        for token in self.tokens(chunk):
            i = self.ids.get(token)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in token.encode())
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return out

    def surface(self, ids: list[int]) -> str:
        """Text of ids, its space marks turned into spaces; runs of byte pieces are read as UTF-8, each wrong byte as U+FFFD."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            kind = self.kind[i]
            if kind == self.byte:
                run.append(int(self.pieces[i][3:5], 16))
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if kind == self.unknown:
                out.append(self.unk_surface)
            elif kind != self.control:
                out.append(self.pieces[i].replace(SPACE, " "))
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out)

    def _entry(self, chunk: str) -> str:
        """Decimal ids of a chunk, from the younger or the older half of the cache, or anew. A full younger half becomes the older one, so frequent chunks stay.

        Ids whose decoding differs from the chunk itself are not cached, and ``odd`` is set: then the text is decoded chunk by chunk.
        """
        value = self.cache.get(chunk) or self.older.get(chunk)
        if value is None:
            ids = self.chunk_ids(chunk)
            value = " ".join(map(str, ids))
            if self.surface(ids) != chunk.replace(SPACE, " "):
                self.odd = True
                return value
        if len(chunk) <= 64:
            if len(self.cache) >= self.keep:
                self.older, self.cache = self.cache, {}
            self.cache[chunk] = value
        return value

    def both(self, text: str | None) -> tuple[str, str]:
        """Decimal ids joined by spaces, with the end id, and the text decoded from them. A null text counts as empty."""
        if not text:
            return str(self.end), ""
        escaped = self.prefix + text.replace(" ", SPACE)
        get, entry = self.cache.get, self._entry
        self.odd = False
        found = [get(c) or entry(c) for c in self.chunks(escaped)]
        if self.odd:
            decoded = self.surface([int(i) for x in found for i in x.split(" ")])
        else:  # every chunk's ids decode to the chunk
            decoded = escaped.replace(SPACE, " ")
        if self.prefix and decoded.startswith(" "):
            decoded = decoded[1:]
        found.append(str(self.end))
        return " ".join(found), decoded

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.both(text)[0].split(" ")]

    def decode(self, ids: list[int]) -> str:
        out = self.surface(ids)
        first = next((i for i in ids if self.kind[i] != self.control), None)
        return out[1:] if self.prefix and first is not None and self.pieces[first].startswith(SPACE) else out


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


_TABLES: dict[str, MergePrefixTable] = {}


def table(model: str) -> MergePrefixTable:
    """The tables of a model, built once per worker."""
    if model not in _TABLES:
        _TABLES[model] = MergePrefixTable(model)
    return _TABLES[model]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, decoded: bool = True) -> DataFrame:
    """Encode every text, decode it again and return id, n_tokens, ids_sha256, decoded_sha256, and on demand the ids and the decoded text.

    Ids end with the end id; no start id, no sampling. Null and empty texts give the end id alone; texts are encoded whole, however long. Other columns of docs, whatever
    their names, are not read; repeated rows are encoded as often as they stand; an empty table gives an empty table. Needs no shuffle.
    ``model`` is a path that exists on every machine.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(model)
        for batch in common.pieces(batches, "_text", 4 << 20):
            rows = [t.both(x) for x in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([i.count(" ") + 1 for i, _ in rows], pa.int64()), pa.array([hashlib.sha256(i.encode()).hexdigest() for i, _ in rows]), pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in rows])]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                values = [np.array(i.split(" "), dtype=np.int32) for i, _ in rows]
                offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32))))
                names.append("ids")
            if decoded:
                columns.append(pa.array([d for _, d in rows]))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded
    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, schema)
