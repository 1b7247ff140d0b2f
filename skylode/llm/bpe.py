"""BPE encoding by forced boundaries: fragments between certain cuts are encoded alone and joined."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from skylode.llm.common import kept_in_worker, map_arrow, texts, tokenizer_text

#: Entries of a worker's cache of words; beyond that it starts anew.
CACHE = 400_000
#: Stands before words that are in byte symbols already; no Latin-1 text holds it.
MAPPED = "\uffff"


class ForcedBoundaryEncoder:
    """Encodes and decodes like the tokenizer file of whose text it is made (BPE over byte symbols with an end-of-word suffix).

    Normalisation and the split into words are those of the file. Inside a
    word two neighbouring bytes that stand side by side in no vocabulary entry
    can never be merged into one token, so the word may be cut there. The
    fragments are encoded each on its own, the last with the end-of-word
    suffix, and their ids concatenated.
    """

    def __init__(self, text: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        spec = json.loads(text)
        self.whole = Tokenizer.from_str(text)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.last = BPE(vocab=vocab, merges=merges, end_of_word_suffix=self.suffix or None)
        # Before the last fragment no symbol has the suffix, so the plain symbols alone matter.
        inner = {k: v for k, v in vocab.items() if not self.suffix or not k.endswith(self.suffix) or k == self.suffix}
        self.inner = BPE(vocab=inner, merges=[m for m in merges if m[0] in inner and m[1] in inner and m[0] + m[1] in inner])
        bare = [k.removesuffix(self.suffix) if self.suffix else k for k in vocab]
        self.joined = {a + b for k in bare for a, b in zip(k, k[1:], strict=False)}
        self.names = {v: k for k, v in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes_as = _byte_symbols()
        #: The file's own word pattern, written out for texts of Latin-1 characters.
        self.latin = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa00-9a-zªµºß-öø-ÿ²³¹¼-¾]+")
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.fragments: dict[tuple[str, bool], tuple[int, ...]] = {}

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            clean = self.whole.normalizer.normalize_str(text)
            return [MAPPED + w for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(clean)]  # already in byte symbols
        return self.latin.findall(text.lower())

    def cuts(self, symbols: str) -> list[str]:
        """Fragments of a word in byte symbols, cut between bytes that no token joins."""
        joined, at, out = self.joined, 0, []
        for i in range(1, len(symbols)):
            if symbols[i - 1 : i + 1] not in joined:
                out.append(symbols[at:i])
                at = i
        out.append(symbols[at:])
        return out

    def word(self, word: str) -> tuple[bytes, str]:
        """The ids of one word as little-endian bytes, and its tokens joined as the decoder joins them."""
        symbols = word[1:] if word[0] == MAPPED else "".join([self.bytes_as[b] for b in word.encode()])
        parts, ids = self.cuts(symbols), []
        for i, part in enumerate(parts):
            key = (part, i + 1 == len(parts))
            if (own := self.fragments.get(key)) is None:
                own = tuple(t.id for t in (self.last if key[1] else self.inner).tokenize(part))
                if len(self.fragments) >= CACHE:
                    self.fragments.clear()
                self.fragments[key] = own
            ids += own
        found = b"".join([x.to_bytes(4, "little") for x in ids]), " ".join([self.names[x] for x in ids])
        if len(self.cache) >= CACHE:
            self.cache.clear()
        if len(word) <= 64:
            self.cache[word] = found
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """A text's ids as little-endian unsigned 32-bit integers, and what they decode to."""
        ids, names, get = [], [], self.cache.get
        for piece in self.at_special.split(text) if self.at_special and "<|" in text else (text,):
            if piece in self.special:
                ids.append(self.special[piece].to_bytes(4, "little"))
                names.append(piece)
            elif piece:
                found = [get(w) or self.word(w) for w in self.words(piece)]
                ids += [x[0] for x in found]
                names += [x[1] for x in found if x[0]]
        return b"".join(ids), " ".join(names)

    def decode(self, ids: bytes) -> str:
        """The text of little-endian unsigned 32-bit ids, special tokens among it; ids that the vocabulary lacks give nothing."""
        names = self.names
        return " ".join([names[x] for x in memoryview(ids).cast("I") if x in names])


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, ids binary, decoded string), one for each row of ``docs``; ids are little-endian unsigned 32-bit.

    Null texts count as empty; an empty text has no ids and decodes to an
    empty one. Long texts go through whole. An empty table gives no rows.
    """
    return _mapped(docs, path, "doc_id long, ids binary, decoded string", lambda found: [pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())])


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256): :func:`encode_documents`, with digests in the place of its values."""

    def sums(found: list[tuple[bytes, str]]) -> list[pa.Array]:
        return [
            pa.array([len(x[0]) // 4 for x in found], pa.int64()),
            pa.array([hashlib.sha256(x[0]).hexdigest() for x in found]),
            pa.array([hashlib.sha256(x[1].encode("utf-8", "surrogatepass")).hexdigest() for x in found]),
        ]

    return _mapped(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", sums)


def _mapped(docs: DataFrame, path: str, schema: str, columns) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    spec, name = tokenizer_text(path)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker(f"bpe {name}", lambda: ForcedBoundaryEncoder(spec))
        for batch in batches:
            found = [encoder.encode(x) for x in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns(found)], names=names)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, schema)


def decode_documents(encoded: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """The columns of ``encoded`` but ``column``, whose ids (binary as from :func:`encode_documents`) become the column ``decoded``, in the place of one of that name.

    Null ids count as none, which decode to an empty text. Bytes that don't make whole ids are an error.
    """
    spec, name = tokenizer_text(path)
    others = [c for c in encoded.columns if c not in (column, "decoded")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker(f"bpe {name}", lambda: ForcedBoundaryEncoder(spec))
        for batch in batches:
            found = [encoder.decode(x or b"") for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(found, pa.string())], names=[*others, "decoded"])

    schema = StructType([*(encoded.schema[c] for c in others), StructField("decoded", StringType())])
    return map_arrow(encoded.select(*(f"`{c}`" for c in (*others, column))), kernel, schema)
