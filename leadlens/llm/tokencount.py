"""Token counts of texts of any length by overlap resynchronisation.

A text longer than one chunk is encoded as overlapping chunks.  Every chunk
encoding carries offsets: the start of each unit and its number of tokens.  A
unit begins at a space between two non-space characters, a place where the
byte-level pre-tokenizer always begins a new piece whatever surrounds it (and
which no added token spans, as checked when the tokenizer is loaded), so a
unit start found in both encodings of an overlap is a proven stable boundary:
the encodings are spliced there, after their counts on the shared units agree.
An overlap without such a boundary (a long run without single spaces) is
doubled until one is found or the chunk reaches the end of the text.

Tokens of a unit come from the tokenizer library; a worker remembers the counts
of the short units it has met, since words repeat, up to ``MEMO_BYTES``.

Defined results: null and empty texts have 0 tokens; repeated rows are counted
each; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from leadlens.llm.common import map_batches

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512
# what a worker remembers: units of so many characters at most, and so many bytes of them (an entry
# counts four bytes a character and 200 for the dictionary)
MEMO_CHARS = 48
MEMO_BYTES = 64 << 20

_tokenizers: dict[str, "Counter"] = {}


class Counter:
    """Counts tokens of texts with one tokenizer file; one per worker process."""

    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.chunk, self.overlap = chunk, overlap
        self.memo: dict[str, int] = {}
        self.held = 0
        # spaces are boundaries only for byte-level splitting without added spaced tokens
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.splits = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                       and not spec.get("normalizer") and not any(" " in t["content"] or t["lstrip"] or t["rstrip"]
                                                                  for t in spec.get("added_tokens", [])))

    def units(self, text: str) -> list[str]:
        """The text cut before each space that stands between two non-space characters."""
        if not self.splits:
            return [text] if text else []
        parts = text.split(" ")
        out, held = [], parts[0]
        for part in parts[1:]:
            if part and held and not part[0].isspace() and not held[-1].isspace():
                out.append(held)
                held = " " + part
            else:
                held += " " + part
        if held:
            out.append(held)
        return out

    def counts(self, units: list[str]) -> list[int]:
        memo = self.memo
        missing = [u for u in dict.fromkeys(units) if u not in memo]
        passing: dict[str, int] = {}
        if missing:
            short = sum(200 + 4 * len(u) for u in missing if len(u) <= MEMO_CHARS)
            if self.held + short > MEMO_BYTES:
                memo.clear()
                self.held, missing = 0, list(dict.fromkeys(units))
                short = sum(200 + 4 * len(u) for u in missing if len(u) <= MEMO_CHARS)
            keep = short <= MEMO_BYTES
            self.held += short if keep else 0
            for i in range(0, len(missing), 4096):
                part = missing[i:i + 4096]
                for u, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                    (memo if keep and len(u) <= MEMO_CHARS else passing)[u] = len(e)
        if not passing:
            return list(map(memo.__getitem__, units))
        return [memo[u] if u in memo else passing[u] for u in units]

    def encode(self, text: str, begin: int) -> tuple[list[int], list[int]]:
        """(unit starts in the whole text, token counts) of one chunk."""
        units = self.units(text)
        starts, at = [], begin
        for u in units:
            starts.append(at)
            at += len(u)
        return starts, self.counts(units)

    def count(self, text: str) -> int:
        n = len(text)
        if n <= self.chunk:
            return sum(self.counts(self.units(text)))
        total, begin, end = 0, 0, self.chunk
        starts, counts = self.encode(text[:end], 0)
        while end < n:
            overlap = self.overlap
            while True:
                # the next chunk starts inside this one; its first unit may be cut, as may the last of this one
                nxt = max(begin + 1, end - overlap)
                stop = min(n, nxt + self.chunk)
                s2, c2 = self.encode(text[nxt:stop], nxt)
                known = dict(zip(s2[1:], c2[1:]))
                shared = [i for i in range(1, len(starts)) if starts[i] in known]
                # the last unit of this chunk may be cut, so its count proves nothing
                agree = all(known[starts[i]] == counts[i] for i in shared if i < len(starts) - 1)
                if shared and agree:
                    total += sum(counts[:shared[0]])
                    j = s2.index(starts[shared[0]])
                    begin, end, starts, counts = s2[j], stop, s2[j:], c2[j:]
                    break
                if overlap >= end - begin:
                    # no boundary anywhere in the chunk: take a longer chunk from the same place
                    end = min(n, begin + 2 * (end - begin))
                    starts, counts = self.encode(text[begin:end], begin)
                    break
                overlap *= 2
        return total + sum(counts)


def counter(path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Counter:
    key = f"{path}|{chunk}|{overlap}"
    if key not in _tokenizers:
        _tokenizers[key] = Counter(path, chunk, overlap)
    return _tokenizers[key]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens of every whole text."""
    fields = docs.select(id_col, text_col)
    id_type = fields.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer_path, chunk, overlap)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                 pa.array([c.count(t) for t in texts], pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    return map_batches(fields, run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long")
