"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The queue has one bucket per merge rank; a bucket holds positions of a linked
list of symbols.  Three levels of 64-bit words say which buckets are filled, so
find-first-set on three words gives the lowest rank.  A merge changes at most two neighbouring
pairs; entries of pairs that no longer exist stay in their buckets and are skipped when popped.
Cost is O(n log n) in the length of a pre-token, however long it is.

One queue serves all pre-tokens of a batch: their symbols lie in one linked list with a barrier
after each, and a popped rank is merged at once in every pre-token that has it (in each, leftmost
occurrence only; others go back, since the merge may have made a lower rank).  Pre-tokens are
independent, so each goes through the same merges as it would alone.

Texts are cut before each space that a non-blank follows.  The split pattern always has a boundary
there and looks at nothing to the left, so chunks are independent and can be remembered.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, parts, table, worker_state

#: Chunks that a worker remembers before it starts afresh, and bytes of text encoded together; both
#: bound memory, never results.
MEMO_ENTRIES, BATCH_BYTES = 250_000, 3 << 20

#: Fixed value: White_Space of Unicode (as a character class), which the split pattern's blanks are.
BLANKS = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class RankQueue:
    """Positions by merge rank; push and pop work on arrays.  A bucket is a list of slices."""

    def __init__(self, n_ranks: int):
        import numpy as np

        self.np = np
        self.low = [0] * ((n_ranks >> 6) + 1)
        self.mid = [0] * ((n_ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list] = {}

    def push(self, rank, pos) -> None:
        """Add positions; rank and pos are arrays of equal length."""
        np = self.np
        if not len(rank):
            return
        order = rank.argsort(kind="stable")
        rank, pos = rank[order], pos[order]
        at = np.concatenate(([0], (rank[1:] != rank[:-1]).nonzero()[0] + 1, [len(rank)])).tolist()
        buckets = self.buckets
        for r, i, j in zip(rank[at[:-1]].tolist(), at, at[1:]):
            bucket = buckets.get(r)
            if bucket is not None:
                bucket.append(pos[i:j])
            else:
                buckets[r] = [pos[i:j]]
                a, b = r >> 6, r >> 12
                self.low[a] |= 1 << (r & 63)
                self.mid[b] |= 1 << (a & 63)
                self.top |= 1 << b

    def pop(self):
        """Remove the lowest filled bucket: (rank, its positions), or None if nothing is queued."""
        top = self.top
        if not top:
            return None
        b = (top & -top).bit_length() - 1
        w = self.mid[b]
        a = (b << 6) + (w & -w).bit_length() - 1
        v = self.low[a]
        rank = (a << 6) + (v & -v).bit_length() - 1
        self.low[a] = v & (v - 1)
        if not self.low[a]:
            self.mid[b] = w & (w - 1)
            if not self.mid[b]:
                self.top = top & (top - 1)
        return rank, self.np.concatenate(self.buckets.pop(rank))


class Merger:
    """Byte-pair merges of many pre-tokens by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        import numpy as np

        self.np = np
        self.barrier = self.n = 1 + max(ranks.values())
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.made = np.array([pairs[k] for k in sorted(pairs)], dtype=np.int64)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)

    def rank_of(self, a, b):
        """Rank of the merge of two arrays of symbols, -1 where there is none."""
        np = self.np
        key = (a << 32) | b
        at = np.minimum(self.keys.searchsorted(key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def _together(self, rank, at, piece, sym, nxt, prv):
        """Of a bucket's sorted positions: those to merge now, and those to queue again.

        Within a pre-token several merges may go together unless one of them could make a pair of
        lower rank, which would come first; then only the leftmost goes.
        """
        np = self.np
        own = piece[at]
        lead = np.ones(len(at), dtype=bool)
        np.not_equal(own[1:], own[:-1], out=lead[1:])
        if lead.all():
            return at, at[:0]
        touch = np.zeros(len(at), dtype=np.int64)
        touch[1:] = at[1:] == nxt[at[:-1]]  # a run of one symbol: every second pair is used up
        if touch.any():
            index = np.arange(len(at))
            keep = (index - np.maximum.accumulate(np.where(touch == 0, index, 0))) % 2 == 0
            at, own, lead = at[keep], own[keep], lead[keep]
        here, before = np.full(len(at), rank), prv[at]
        made = np.stack((self.rank_of(here, sym[nxt[nxt[at]]]), np.where(before >= 0, self.rank_of(sym[before], here), -1), self.rank_of(here, here)))
        bad = ((made >= 0) & (made < rank)).any(0)
        if not bad.any():
            return at, at[:0]
        now = lead | ~np.isin(own, own[bad])
        return at[now], at[~now]

    def __call__(self, pieces: list[bytes]):
        """Ids of all pieces as one int array, and where each piece's ids end."""
        np = self.np
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ends = np.cumsum(sizes + 1)
        n = int(ends[-1])
        real = np.ones(n, dtype=bool)
        real[ends - 1] = False  # barriers
        sym = np.full(n, self.barrier, dtype=np.int64)
        sym[real] = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), sizes + 1)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        pair = np.full(n, -1, dtype=np.int64)
        pair[:-1] = self.rank_of(sym[:-1], sym[1:])
        queue = RankQueue(self.n)
        start = (pair >= 0).nonzero()[0]
        queue.push(pair[start], start)
        alive = real
        while (got := queue.pop()) is not None:
            rank, at = got
            at = at[pair[at] == rank]  # others are stale
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                at, later = self._together(rank, at, piece, sym, nxt, prv)
                if len(later):
                    queue.push(np.full(len(later), rank), later)
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = rank
            nxt[at] = after
            prv[after] = at
            alive[gone] = False
            pair[gone] = -1
            before = prv[at]
            here = np.full(len(at), rank)
            ok = before >= 0
            ok[1:] &= before[1:] != at[:-1]  # else that pair starts at the merge before
            both = np.concatenate((self.rank_of(here, sym[after]), self.rank_of(sym[before[ok]], here[ok])))
            where = np.concatenate((at, before[ok]))
            pair[where] = both
            new = both >= 0
            queue.push(both[new], where[new])
        counts = np.add.reduceat(alive, np.concatenate(([0], ends[:-1])), dtype=np.int64)
        return sym[alive], np.cumsum(counts)


class Codec:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, rank_lines: list[bytes], pattern: str, memo: int = MEMO_ENTRIES):
        import re

        import numpy as np
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, rank_lines))}
        self.merge = Merger(self.ranks)
        self.bytes_of = [b""] * self.merge.n
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.find = regex.compile(pattern).findall
        self.cut = re.compile(f" (?=[^{BLANKS}])").split
        self.blank = re.compile(f"[{BLANKS}]").search
        self.np, self.memo, self.known = np, memo, {}

    def _ids(self, pieces) -> dict[str, bytes]:
        """Ids of pre-tokens."""
        raw = {p: p.encode() for p in pieces}
        ids = {p: self.ranks[r].to_bytes(4, "little") for p, r in raw.items() if r in self.ranks}
        hard = [p for p in raw if p not in ids]
        if hard:
            flat, ends = self.merge([raw[p] for p in hard])
            flat, ends = flat.astype("<u4").tobytes(), (4 * ends).tolist()
            ids |= {p: flat[i:j] for p, i, j in zip(hard, [0, *ends], ends)}
        return ids

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A chunk is remembered without its leading space; the first of a text has none and is not
        remembered.  New chunks are split together, one to a line, as a line break before a space
        and a non-blank is always a pre-token of its own; chunks with blanks inside go alone.
        """
        if len(self.known) > self.memo:
            self.known = {}
        cuts = [self.cut(text) for text in texts]
        firsts = [self.find(c.pop(0)) for c in cuts]
        known = self.known
        new = set().union(*cuts).difference(known)
        odd = [c for c in new if self.blank(c)]
        new = list(new.difference(odd))
        flat = self.find(" " + "\n ".join(new)) if new else []
        odd_parts = [self.find(" " + c) for c in odd]
        ids = self._ids(set(flat).union(*firsts, *odd_parts))
        get = ids.__getitem__
        long = {c: b"".join(map(get, found)) for c, found in zip(odd, odd_parts)}
        heads = [b"".join(map(get, found)) for found in firsts]
        if new:
            stop = b"\xff" * 4  # never part of an id, as ids are below 2**24
            ids["\n"] = stop
            known.update(zip(new, b"".join(map(get, flat)).split(stop)))
        known.update(long)
        out = [head + b"".join(map(known.__getitem__, c)) for head, c in zip(heads, cuts)]
        for c in long:
            del known[c]
        return out

    def decode(self, ids: bytes) -> bytes:
        """Bytes of a sequence of ids."""
        return b"".join(map(self.bytes_of.__getitem__, self.np.frombuffer(ids, dtype="<u4").tolist()))


def load_codec(path: str | None, pattern: str | None) -> Codec:
    """The worker's codec for a rank file; None means the public 50k vocabulary of this machine."""
    key = ("bpe", path, pattern)
    state = worker_state()
    if key not in state:
        if path is None or pattern is None:
            import public_tokenizers

            path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
        with open(path, "rb") as f:
            state[key] = Codec(f.read().splitlines(), pattern)
    return state[key]


def encode_documents(docs: DataFrame, rank_path: str | None = None, pattern: str | None = None, text: str = "text", with_ids: bool = True, batch_bytes: int = BATCH_BYTES, memo: int = MEMO_ENTRIES) -> DataFrame:
    """Encode every whole text and decode it again; keeps doc_id and adds token columns.

    batch_bytes and memo (bytes of text encoded together, chunks remembered) trade a worker's memory
    for time and change no result.

    Columns: doc_id, n_tokens, ids (array of int, if with_ids), ids_sha256, decoded_sha256.
    Null and empty texts have no tokens; repeated rows give repeated results; other columns of the
    input are ignored, so clashing names do no harm.  No shuffle: one pass over the rows.
    """
    schema = "doc_id long, n_tokens long, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        codec = load_codec(rank_path, pattern)
        codec.memo = memo
        for batch in batches:
            for part in parts(batch, 1, batch_bytes):
                got = codec.encode_batch([b.decode("utf-8", "replace") for b in as_bytes(part.column(1))])
                columns = {"doc_id": part.column(0), "n_tokens": pa.array([len(g) // 4 for g in got], pa.int64())}
                if with_ids:
                    columns["ids"] = pa.array([np.frombuffer(g, dtype="<i4") for g in got], pa.list_(pa.int32()))
                columns["ids_sha256"] = pa.array([hashlib.sha256(g).hexdigest() for g in got], pa.string())
                columns["decoded_sha256"] = pa.array([hashlib.sha256(codec.decode(g)).hexdigest() for g in got], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), with_ids=False)
