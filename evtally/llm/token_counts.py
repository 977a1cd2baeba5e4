"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are emitted."""

from __future__ import annotations

import heapq
import json
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

#: The byte-level pre-tokeniser's pattern with white space by its Unicode property (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CACHE_ENTRIES = 1 << 20
_LOADED: dict[int, "Counter"] = {}


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


def understood(j: dict) -> None:
    """Raise an error for any setting of the file under which this counter would count otherwise than its library."""
    model, split = j["model"], j.get("pre_tokenizer") or {}
    fits = {
        "model": model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "normalizer": j.get("normalizer") is None,
        "pre_tokenizer": split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True),
        "added_tokens": not any(t.get(k) for t in j.get("added_tokens") or () for k in ("single_word", "lstrip", "rstrip")),
    }
    if bad := [k for k, fine in fits.items() if not fine]:
        raise ValueError(f"not a plain byte-level byte-pair file: {', '.join(bad)}")


class Counter(dict):
    """Tokens of one pre-token, remembered for as many as CACHE_ENTRIES of them."""

    def __init__(self, spec: str):
        import regex

        j = json.loads(spec)
        understood(j)
        vocab, symbols = j["model"]["vocab"], byte_symbols()
        self.first = [vocab.get(s, -1) for s in symbols]
        self.pairs = {}
        for rank, merge in enumerate(j["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        specials = sorted((t["content"] for t in j.get("added_tokens") or []), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.split = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        out = self[piece] = self.merged(piece.encode())
        return out

    def merged(self, data: bytes) -> int:
        """Initial symbols minus merges: pop the lowest-ranked adjacent pair, the leftmost first."""
        pairs, n = self.pairs, len(data)
        pack = list if n < 1024 else lambda x: array("i", x)  # a long run of letters is one piece
        ids, after, before = pack(map(self.first.__getitem__, data)), pack(range(1, n + 1)), pack(range(-1, n - 1))
        heap = [p[0] << 32 | i for i in range(n - 1) if (p := pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        count = n
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n or not (p := pairs.get((ids[i], ids[j]))) or p[0] != top >> 32:
                continue  # one of the two was merged meanwhile
            new = ids[i] = p[1]
            ids[j], k = -2, after[j]
            after[i] = k
            count -= 1
            if k < n:
                before[k] = i
                if p := pairs.get((new, ids[k])):
                    heapq.heappush(heap, p[0] << 32 | i)
            if (h := before[i]) >= 0 and (p := pairs.get((ids[h], new))):
                heapq.heappush(heap, p[0] << 32 | h)
        return count

    def tokens(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.split(x))) for x in parts if x)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row's whole text.

    tokenizer: path of a byte-level BPE file, read on the driver and broadcast (a vocabulary file
    is a few MB whatever the data). Null and empty texts have 0 bytes and tokens; special strings
    inside a text count one token; repeated rows and null ids are kept, each with its own count;
    further columns are ignored. Rows need no shuffle and are scored in Arrow batches.
    """
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    understood(json.loads(text))
    spec = docs.sparkSession.sparkContext.broadcast(text)
    key = hash(spec.value)

    def count(batches):
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = Counter(spec.value)
        of = _LOADED[key].tokens
        for b in sliced(batches):
            n = [of(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

