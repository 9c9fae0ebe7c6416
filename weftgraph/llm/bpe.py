"""Byte-level BPE: recursive DuckDB queries inside each partition encode and decode.

Method: a text is cut into pieces by the tokenizer's pattern. The distinct pieces of a run of texts that the worker
has not met become token-position rows (piece, start, end, token, next token), one per byte. A recursive query joins
the rows with the merge table and contracts each piece's leftmost pair of minimum rank, round by round, until no piece
has a pair left; an ordered aggregation reads the ids off, and a second one, over the ids joined with the vocabulary,
decodes them. A query holds all its rounds, so it stops after ``SQL_ROWS`` / rows of them; pieces that are not done
then go on in a second form of the query, where a round takes all occurrences of a piece's minimum rank, leftmost first
and never two that overlap, up to the first whose merged token makes a pair of a lower rank with a neighbour, as that
pair would come next. Both forms contract the same pairs; the second takes fewer rounds, each of which costs more.

Pieces are independent, so a bounded per-worker memo of their ids changes speed only; it starts with the vocabulary's
own texts, which are their own token, as in the library. Texts are put together from their pieces by Arrow
dictionaries: each run's distinct pieces are looked up once and gathered by index.

The merge table is read on the driver from the rank file named by a parameter and broadcast: its size is that of
the vocabulary, not of the corpus. Memory in a worker is bounded by the Arrow batch, ``MEMO_PIECES``, ``SQL_BYTES`` and
``SQL_ROWS``. DuckDB writes no files.

Defined results: a null text counts as empty; an empty text has 0 tokens and the ids string ''; pieces of any length
take the same way; repeated rows get equal rows; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays

MEMO_PIECES = 200_000
#: Of one query: the bytes of its pieces (one piece at least), and about the rows that its rounds hold together.
SQL_BYTES, SQL_ROWS = 250_000, 4_000_000
#: Characters of the texts whose pieces are put together at once.
RUN_CHARS = 1_000_000

#: w: piece, k, e: start and end in bytes, with a gap after each piece, t: token, n: the next token or -1, p: rank of the
#: pair with the next token * 2^32 + k, or null.
_START = "SELECT 0::INTEGER, w, k, e, t, n, m.o << 32 | k FROM base LEFT JOIN merges m ON m.lr = (t::BIGINT << 32 | n)"
_END = """
CREATE OR REPLACE TEMP TABLE coded AS
WITH RECURSIVE s(step, w, k, e, t, n, p) AS ({start} UNION ALL ({round})),
last AS (SELECT w, max(step) AS step, max(p) FILTER (step = {rounds}) IS NOT NULL AS more FROM s GROUP BY w)
SELECT w, k, e, t, n, more FROM s JOIN last USING (w, step)
"""
#: The pair's second row becomes the merged token, its first row goes, and the row before it has a new next token.
ONE = """
SELECT step + 1, w, q.k, e, t, n, CASE WHEN q.lr IS NULL THEN p ELSE m.o << 32 | q.k END FROM (
  SELECT step, s.w, CASE WHEN s.k = b.m THEN b.k ELSE s.k END AS k, s.e, CASE WHEN s.k = b.m THEN b.x ELSE t END AS t, CASE WHEN s.e = b.k THEN b.x ELSE n END AS n, p,
    CASE WHEN s.k = b.m THEN b.x::BIGINT << 32 | n WHEN s.e = b.k THEN t::BIGINT << 32 | b.x END AS lr
  FROM s JOIN (
    SELECT w, (min(p) >> 32)::INTEGER AS x, (min(p) & 4294967295)::INTEGER AS k, arg_min(e, p) AS m FROM s WHERE p IS NOT NULL GROUP BY w
  ) AS b ON s.w = b.w WHERE s.k <> b.k AND step < {rounds}
) AS q LEFT JOIN merges m ON m.lr = q.lr
"""
ALL = """
WITH best AS (SELECT w, (min(p) >> 32)::INTEGER AS x FROM s WHERE p IS NOT NULL GROUP BY w),
able AS (
  SELECT w, x, s.k, s.e, row_number() OVER o AS i, lag(s.e) OVER o AS before FROM s JOIN best USING (w) WHERE s.p >> 32 = x WINDOW o AS (ORDER BY s.k)
), apart AS (
  SELECT w, x, k, e FROM (SELECT *, i - max(CASE WHEN before IS DISTINCT FROM k THEN i END) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS j FROM able) WHERE j % 2 = 0
), stop AS (
  SELECT a.w, min(a.k) AS k FROM apart a LEFT JOIN s y ON y.k = a.e LEFT JOIN s z ON z.e = a.k
  LEFT JOIN merges m ON m.lr = (x::BIGINT << 32 | y.n) LEFT JOIN merges h ON h.lr = (z.t::BIGINT << 32 | x) LEFT JOIN merges d ON d.lr = (x::BIGINT << 32 | x)
  WHERE least(m.o, h.o, d.o) < x GROUP BY a.w
), pick AS (SELECT a.k, a.e FROM apart a LEFT JOIN stop USING (w) WHERE stop.k IS NULL OR a.k <= stop.k),
moved AS (
  SELECT step, w, coalesce(a.k, s.k) AS k, s.e, CASE WHEN a.k IS NULL THEN t ELSE x END AS t, CASE WHEN z.k IS NULL THEN n ELSE x END AS n, s.p, a.k IS NOT NULL OR z.k IS NOT NULL AS fresh
  FROM s JOIN best USING (w) LEFT JOIN pick a ON s.k = a.e LEFT JOIN pick z ON s.e = z.k ANTI JOIN pick f ON s.k = f.k WHERE step < {rounds}
)
SELECT step + 1, w, k, e, t, n, CASE WHEN fresh THEN m.o << 32 | k ELSE p END FROM moved LEFT JOIN merges m ON m.lr = CASE WHEN fresh THEN t::BIGINT << 32 | n END
"""
#: The ids, each behind a space, and the bytes that they decode to.
READ = """
SELECT w, ' ' || string_agg(t, ' ' ORDER BY k) AS ids, count(*) AS n, unhex(string_agg(h, '' ORDER BY k)) AS decoded
FROM coded JOIN vocab ON t = id WHERE NOT more GROUP BY w ORDER BY w
"""
REST = "SELECT w, k, e, t, n FROM coded WHERE more"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def _hashes(pieces: pa.Array) -> np.ndarray:
    data, offsets = arrays.text_bytes(pieces)
    return arrays.word_hashes(data, offsets[:-1], offsets[1:])


class Coder:
    """Encodes and decodes pieces through DuckDB; one lives in each Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.split = regex.compile(pattern).findall
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        merges = pa.table({"lr": pa.array([a << 32 | b for a, b, _ in pairs], pa.int64()), "o": pa.array([c for *_, c in pairs], pa.int64())})
        vocab = pa.table({"id": pa.array(ranks.values(), pa.int32()), "h": [b.hex() for b in ranks]})
        for name, data in (("merges", merges), ("vocab", vocab)):
            self.db.register("_t", data)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM _t")
            self.db.unregister("_t")
        own = {}
        for t, r in ranks.items():
            try:
                own[t.decode()] = r
            except UnicodeDecodeError:
                continue
        #: The memo: pieces with their ids, their count and bytes; in how many runs each was met; sorted hashes of the pieces, and where each stands.
        self.own = pa.table({"piece": pa.array(own, pa.large_string()), "ids": pa.array([b" %d" % r for r in own.values()], pa.large_binary()), "n": pa.array(np.ones(len(own), np.int64)), "decoded": pa.array([t.encode() for t in own], pa.large_binary())})
        self.forget(self.own)
        del pairs, merges, vocab, own
        arrays.give_back()

    def forget(self, kept: pa.Table) -> None:
        self.known, self.met = kept, np.zeros(kept.num_rows, np.int32)
        keys = _hashes(kept["piece"].combine_chunks())
        self.places = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.places]

    def code_pieces(self, pieces: pa.Array) -> pa.Table:
        """(piece, ids each behind a space, n of them, bytes decoded from them) of distinct non-empty pieces, in their order, by the recursive queries and the aggregations."""
        data, offsets = arrays.text_bytes(pieces)
        sizes = np.diff(offsets)
        w = np.repeat(np.arange(len(sizes)), sizes)
        k, token, final = np.arange(len(data)) + w, self.of_byte[data], np.zeros(len(data), bool)
        final[offsets[1:] - 1] = True
        base = pa.table({n: pa.array(x, pa.int32()) for n, x in (("w", w), ("k", k), ("e", k + 1), ("t", token), ("n", np.where(final, -1, np.roll(token, -1))))})
        parts, form = [], ONE
        while base.num_rows:
            rounds = max(1, SQL_ROWS // base.num_rows)
            self.db.register("base", base)
            self.db.execute(_END.format(start=_START, round=form.format(rounds=rounds), rounds=rounds))
            parts.append(self.db.sql(READ).to_arrow_table())
            base = self.db.sql(REST).to_arrow_table()
            self.db.unregister("base")
            form = ALL
        self.db.execute("DROP TABLE IF EXISTS coded")
        del base
        found = pa.concat_tables(parts)
        found = found if len(parts) == 1 else found.sort_by("w")
        return pa.table({"piece": pieces, **{c: found[c].combine_chunks().cast(f) for c, f in (("ids", pa.large_binary()), ("n", pa.int64()), ("decoded", pa.large_binary()))}})

    def numbers(self, pieces: pa.Array) -> np.ndarray:
        """The memo's number of each distinct piece; those it lacks are coded first. Over the bound, pieces that only one run has met go, or else all."""
        if self.known.num_rows > MEMO_PIECES + self.own.num_rows:
            self.met[: self.own.num_rows] = 2
            kept = self.known.take(np.flatnonzero(self.met > 1))
            self.forget(kept.combine_chunks() if kept.num_rows < MEMO_PIECES // 2 + self.own.num_rows else self.own)
        keys = _hashes(pieces)
        near = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        at = self.places[near].astype(np.int64)
        # A hash only proposes; the pieces themselves are compared.
        at[(self.keys[near] != keys) | ~pc.equal(self.known["piece"].combine_chunks().take(at), pieces).to_numpy(zero_copy_only=False)] = -1
        new = np.flatnonzero(at < 0)
        if len(new):
            # Alike lengths take alike many rounds.
            fresh = pieces.take(new)
            size = np.diff(arrays.text_bytes(fresh)[1])
            order = np.argsort(size, kind="stable")
            new = new[order]
            fresh, block = fresh.take(order), np.cumsum(size[order]) // SQL_BYTES
            edge = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(new)]))
            made = pa.concat_tables([self.code_pieces(fresh.slice(a, b - a)) for a, b in zip(edge[:-1], edge[1:], strict=True)])
            at[new] = self.known.num_rows + np.arange(len(new))
            self.known = pa.concat_tables([self.known, made]).combine_chunks()
            self.met = np.concatenate((self.met, np.zeros(len(new), np.int32)))
            order = np.argsort(keys[new], kind="stable")
            where = np.searchsorted(self.keys, keys[new][order])
            self.keys, self.places = np.insert(self.keys, where, keys[new][order]), np.insert(self.places, where, at[new][order].astype(np.int32))
        self.met[at] += 1
        return at

    def texts(self, texts: list[str]) -> Iterator[tuple[memoryview, int, memoryview]]:
        """(ids joined by spaces, their number, decoded bytes) of each text; texts are taken in runs of RUN_CHARS."""
        k = 0
        while k < len(texts):
            flat, counts, size = [], [0], 0
            while k < len(texts) and (not size or size + len(texts[k]) < RUN_CHARS):
                flat += self.split(texts[k])
                counts.append(len(flat))
                size += len(texts[k])
                k += 1
            coded = pa.array(flat, pa.large_string()).dictionary_encode()
            del flat
            rows = self.numbers(coded.dictionary)
            edge = np.array(counts)
            held, index = self.known.take(rows), coded.indices
            number = np.concatenate(([0], np.cumsum(held["n"].to_numpy()[index.to_numpy()])))[edge]
            parts = []
            for name in ("ids", "decoded"):
                joined = held[name].combine_chunks().take(index)
                parts.append((memoryview(joined.buffers()[2] or b"").cast("B"), np.frombuffer(joined.buffers()[1], np.int64)[edge] if len(joined) else edge))
            (ids, a), (decoded, b) = parts
            del coded, held, index
            arrays.give_back()
            for i in range(len(counts) - 1):
                yield ids[a[i] + 1 : a[i + 1]], int(number[i + 1] - number[i]), decoded[b[i] : b[i + 1]]


_coders: dict[tuple[str, str], Coder] = {}


def _release() -> None:
    while _coders:
        _coders.popitem()[1].db.close()


arrays.caches[__name__] = _release


def _coder(name: str, ranks: dict[bytes, int], pattern: str) -> Coder:
    """The worker's coder for this vocabulary, which is known by a digest of its content."""
    if (name, pattern) not in _coders:
        _release()
        _coders[name, pattern] = Coder(ranks, pattern)
    return _coders[name, pattern]


def digest(ranks: dict[bytes, int]) -> str:
    return hashlib.sha256(b"".join(b"%d %s\n" % (r, t.hex().encode()) for t, r in ranks.items())).hexdigest()


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", outputs: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256), and with ``outputs`` the ids and the decoded text themselves."""
    table = read_ranks(ranks_path)
    name, ranks = digest(table), docs.sparkSession.sparkContext.broadcast(table)
    keep = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    kind = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * outputs)

    @arrays.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coder = _coder(name, ranks.value, pattern)
            rows = []
            for ids, n, decoded in coder.texts(batch.column("t").to_pylist()):
                row = [n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()]
                rows.append(row + [[int(x) for x in bytes(ids).split()], bytes(decoded).decode("utf-8", "replace")] * outputs)
            columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), *columns], names=["k", *kind.names])

    schema = f"k {keep.schema['k'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * outputs
    return keep.mapInArrow(run, schema).withColumnRenamed("k", key)
