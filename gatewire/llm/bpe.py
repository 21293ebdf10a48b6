"""Byte-level BPE encoding and decoding with a public rank file, by recursive DuckDB queries in every task.

A text is cut by the tokenizer's pattern; a piece that is in the vocabulary is
that id.  Every other piece becomes rows (word, position, token), one per byte.
A step of the recursive query joins neighbouring rows with the merge table and
contracts the word's leftmost pair of least rank, until no pair is left.  Pieces
of more than ``LONG`` bytes go through a second query whose rows point to their
successor; it contracts in one step all disjoint pairs of the least rank, where
no merge of the new token could have come first, and keeps one state of a row.
Decoding joins the ids with the vocabulary and puts their bytes together with an
ordered aggregate.

The merge table holds every split of a vocabulary entry into two entries, so it
is bounded by the vocabulary; the file's content is broadcast.  A worker keeps
the ids of up to twice ``CACHE`` pieces: when so many are young they become the old
ones, of which those that are met again are young once more and the others are forgotten.

Defined cases: NULL counts as empty and gives no ids; special tokens' strings are
ordinary text; texts are taken in blocks of ``BLOCK`` pieces, however long.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ready, slices

LONG = 64
CACHE = 300_000
BLOCK = 200_000
BATCH_CHARS = 1_000_000

# One contraction per word and step; the last step of a word holds its tokens.
_SHORT = """
with recursive s(w, pos, tok, step) as (
  select w, pos, tok, 0 from start
  union all
  (with pair as (
     select a.w, a.pos, m.tok as rank
     from s a join s b on a.w = b.w and b.pos = a.pos + 1 join merges m on m.l = a.tok and m.r = b.tok),
   best as (select w, min(rank::bigint * 1048576 + pos) as k from pair group by w)
   select s.w, case when s.pos > (k & 1048575) then s.pos - 1 else s.pos end,
          case when s.pos = (k & 1048575) then (k >> 20)::int else s.tok end, step + 1
   from s join best using (w) where s.pos <> (k & 1048575) + 1)
)
select w, pos, tok from s join (select w, max(step) as step from s group by w) using (w, step) order by w, pos
"""

# One state per row: contracted rows stay as tok NULL, ``nxt`` is the position of the next token.
_WIDE = """
with recursive s(w, pos, tok, nxt) using key (w, pos) as (
  select w, pos, tok, nxt from start
  union
  (with live as (select r.* from recurring.s r where tok is not null and w in (select w from s)),
   pair as (
     select a.w, a.pos, a.nxt, b.nxt as after, m.tok as rank, m.alone
     from live a join live b on a.w = b.w and b.pos = a.nxt join merges m on m.l = a.tok and m.r = b.tok),
   best as (select w, min(rank) as rank from pair group by w),
   hit as (select pair.* from pair join best using (w, rank)),
   run as (
     select *, sum(case when before = pos then 0 else 1 end) over (partition by w order by pos) as island
     from (select *, lag(nxt) over (partition by w order by pos) as before from hit)),
   take as (
     select * from (select *, row_number() over (partition by w, island order by pos) as nth,
                           row_number() over (partition by w order by pos) as all_nth from run)
     where case when alone then all_nth = 1 else nth % 2 = 1 end)
   select w, pos, rank, after from take
   union all
   select w, nxt, null, null from take)
)
select w, pos, tok from s where tok is not null order by w, pos
"""


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


class Codec:
    """Encoder and decoder of one rank file and pattern; lives as long as its worker."""

    _made: dict[tuple[bytes, str], Codec] = {}

    @classmethod
    def of(cls, content: bytes, pattern: str) -> Codec:
        key = hashlib.sha256(content).digest(), pattern
        if key not in cls._made:
            cls._made[key] = cls(content, pattern)
        return cls._made[key]

    def __init__(self, content: bytes, pattern: str) -> None:
        import duckdb
        import regex

        self.ranks = read_ranks(content)
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        left, right, both = [], [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), both.append(rank)
        merges = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "tok": pa.array(both, pa.int32())})
        vocabulary = pa.table(
            {"id": pa.array(list(self.ranks.values()), pa.int32()), "hex": pa.array([t.hex() for t in self.ranks])}
        )
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "preserve_insertion_order": False})
        self.con.register("read_merges", merges)
        self.con.register("read_vocabulary", vocabulary)
        # alone: some merge with this token ranks before the token itself
        self.con.execute(
            "create table merges as select *, tok in (select l from read_merges where tok < l union all "
            "select r from read_merges where tok < r) as alone from read_merges"
        )
        self.con.execute("create table vocabulary as select * from read_vocabulary")
        self.con.unregister("read_merges")
        self.con.unregister("read_vocabulary")

    def pieces(self, text: str):
        if len(text) <= BATCH_CHARS:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while block := list(islice(found, BLOCK)):
            yield block

    def learn(self, new) -> None:
        """Put the ids of pieces into the cache."""
        short, wide = [], []
        for piece in new:
            raw = piece.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.known[piece] = rank.to_bytes(4, "little")
            else:
                (short if len(raw) <= LONG else wide).append((piece, raw))
        for group, query in ((short, _SHORT), (wide, _WIDE)):
            for low in range(0, len(group), 50_000):
                self._contract(group[low : low + 50_000], query)

    def _contract(self, group: list[tuple[str, bytes]], query: str) -> None:
        lengths = np.array([len(raw) for _, raw in group])
        token = self.byte_ids[np.frombuffer(b"".join(raw for _, raw in group), np.uint8)]
        word = np.repeat(np.arange(len(group), dtype=np.int32), lengths)
        position = (np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        self.con.register("start", pa.table({"w": word, "pos": position, "tok": token, "nxt": position + np.int32(1)}))
        found = self.con.sql(query).to_arrow_table()
        self.con.unregister("start")
        ids = found["tok"].to_numpy().astype("<u4")
        ends = np.searchsorted(found["w"].to_numpy(), np.arange(len(group) + 1))
        for i, (piece, _) in enumerate(group):
            self.known[piece] = ids[ends[i] : ends[i + 1]].tobytes()

    def encode(self, texts: list[str]):
        """For every text in turn (its number, little-endian 32-bit ids, whether its last); long texts in several parts."""
        waiting, size = [], 0
        for number, text in enumerate(texts):
            if len(text) <= BATCH_CHARS:
                waiting.append((number, self.pattern.findall(text), True))
                size += len(text)
                if size > BATCH_CHARS:
                    yield from self._ids(waiting)
                    waiting, size = [], 0
                continue
            yield from self._ids(waiting)
            waiting, size = [], 0
            for block in self.pieces(text):
                yield from self._ids([(number, block, False)])
            yield number, b"", True
        yield from self._ids(waiting)

    def _ids(self, waiting):
        looked_up = [list(map(self.known.get, pieces)) for _, pieces, _ in waiting]
        gaps = [i for i, ids in enumerate(looked_up) if None in ids]
        if gaps:
            fresh = {piece for i in gaps for piece, ids in zip(waiting[i][1], looked_up[i]) if ids is None}
            again = {piece: ids for piece in fresh if (ids := self.old.get(piece)) is not None}
            if len(self.known) + len(fresh) > CACHE:
                self.old, self.known = self.known, {}
            self.known.update(again)
            self.learn(fresh - again.keys())
            for i in gaps:
                young = map(self.known.get, waiting[i][1])
                looked_up[i] = [self.old[piece] if ids is None else ids for piece, ids in zip(waiting[i][1], young)]
        return [(number, b"".join(ids), last) for (number, _, last), ids in zip(waiting, looked_up)]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes behind each run of ids."""
        counts = np.array([len(x) // 4 for x in ids], np.int64)
        if not counts.sum():
            return [b""] * len(ids)
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        run = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
        self.con.register("given", pa.table({"run": run, "pos": np.arange(len(flat), dtype=np.int32), "id": flat}))
        found = self.con.sql(
            "select run, unhex(array_to_string(list(hex order by pos), '')) as content "
            "from given join vocabulary using (id) group by run"
        ).to_arrow_table()
        self.con.unregister("given")
        out = [b""] * len(ids)
        for at, content in zip(found["run"].to_pylist(), found["content"].to_pylist()):
            out[at] = content
        return out


def _digests(content, pattern: str, with_ids: bool):
    def run(batches):
        codec = Codec.of(content.value, pattern)
        for batch in batches:
            for part in slices(batch, "__text", 2 << 20):
                texts = [t or "" for t in part.column("__text").to_pylist()]
                rows = len(texts)
                tokens, encoded, decoded = [0] * rows, [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
                kept: list[list[bytes]] = [[] for _ in texts]
                waiting, size = [], 0
                for number, ids, last in chain(codec.encode(texts), [(-1, b"", True)]):
                    if number >= 0:
                        tokens[number] += len(ids) // 4
                        encoded[number].update(ids)
                        if with_ids:
                            kept[number].append(ids)
                        waiting.append((number, ids))
                        size += len(ids)
                    if size > 2_000_000 or number < 0:
                        for (owner, _), content_of in zip(waiting, codec.decode([ids for _, ids in waiting])):
                            decoded[owner].update(content_of)
                        waiting, size = [], 0
                columns = [
                    part.column("__id"),
                    pa.array(tokens, pa.int64()),
                    pa.array([h.hexdigest() for h in encoded]),
                    pa.array([h.hexdigest() for h in decoded]),
                ]
                if with_ids:
                    flat = [np.frombuffer(b"".join(parts), "<u4").astype(np.int32) for parts in kept]
                    columns.append(pa.array(flat, pa.list_(pa.int32())))
                names = ["__id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_and_decode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every text; the decoded bytes come from the ids alone."""
    spark = ready(docs.sparkSession)
    with open(ranks_path, "rb") as file:
        content = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    schema = f"__id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(_digests(content, pattern, with_ids), schema).withColumnRenamed("__id", id_col)
