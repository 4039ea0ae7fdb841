"""Ranking operators: exact neighbours, per-key winners, margins, caps, bands and merges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomquery.session import materialize, spread

#: Queries that go to the workers at once, and pool rows that are compared with them at once; of those, a tile of at most
#: TILE pairs is held as an array. Maxima by label leave a task at KEPT of them. Where a task keeps the best k of each
#: query, up to 4 * QUERIES go at once, as long as their lists stay under LISTED rows. Rows in order leave a task at RUN.
QUERIES, ROWS, TILE, KEPT, LISTED, RUN = 2048, 4096, 1 << 20, 1 << 22, 1 << 19, 1 << 23

#: Bands of similarity that an expanding search counts rows in; a power of two, so that their edges are exact.
BINS = 256


def first_per_key(df: DataFrame, keys: list[str], *order: Column | str, k: int = 1, rank: str | None = None) -> DataFrame:
    """The first k rows of every key; `rank` keeps the row number under that name."""
    name = rank or "__rank"
    got = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return got if rank else got.drop(name)


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of unit rows, their lengths) of a column of vectors; a missing vector, or one with a missing component,
    has length -1 and zeros, and one of vanishing norm is zeros."""
    lens = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if len(lens) and (lens == lens[0]).all():
        out = np.array(flat).reshape(len(lens), int(lens[0]))
    else:
        row = np.repeat(np.arange(len(lens)), lens)
        out = np.zeros((len(lens), int(lens.max(initial=0))))
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    bad = ~np.isfinite(out).all(axis=1) | ~np.asarray(column.is_valid())
    out[bad] = 0
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0), np.where(bad, -1, lens)


def _cosines(p: tuple, q: tuple) -> np.ndarray:
    """(pool rows, queries) cosines clipped at 0; 0 between vectors of unequal lengths."""
    width = max(p[0].shape[1], q[0].shape[1])
    a, b = (x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (p[0], q[0]))
    out = a @ b.T
    np.maximum(out, 0.0, out=out)
    if len(np.unique(np.concatenate([p[1], q[1]]))) > 1:
        out[(p[1][:, None] != q[1][None, :]) | (p[1][:, None] < 0)] = 0
    return out


def _set(ok: np.ndarray) -> np.ndarray:
    """Places of the few that are set, eight at a look."""
    flat = ok.ravel()
    whole = flat.size // 8 * 8
    at = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])


def _reaching(p: np.ndarray, q: np.ndarray, single: np.ndarray, bar: np.ndarray) -> tuple | None:
    """(pool row, query, cosine clipped at 0) of the pairs of unit rows that reach their query's bar: sought in single
    precision (`single` is q in it, transposed), with room for its error, and worked out in double. A few pairs under
    the bar may be among them; nothing comes back where they are too many for this to be cheaper than all in double."""
    room = (p.shape[1] + 8) * 2.0**-23  # over twice the largest error of a sum of products of rounded unit rows
    low = np.where(bar > room, bar - room, -2.0).astype(np.float32)
    ok = p.astype(np.float32) @ single >= np.nextafter(low, np.float32(-3))
    at = _set(ok)
    if len(at) > ok.size // 16:
        return None
    row, col = np.divmod(at, ok.shape[1])
    raw, step = np.empty(len(at)), max(1, TILE // max(1, p.shape[1]))
    for lo in range(0, len(at), step):
        raw[lo : lo + step] = np.einsum("ij,ij->i", p[row[lo : lo + step]], q[col[lo : lo + step]])
    return row, col, np.maximum(raw, 0.0)


def _cosine(raw: np.ndarray) -> np.ndarray:
    return np.round(raw, 6)


def _bits(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes as unsigned longs, whether there is one)."""
    ok = np.asarray(column.is_valid())
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), ok


def _agreeing(p: tuple, q: tuple) -> np.ndarray:
    """(pool rows, queries) equal bits of 64; 0 where a hash is missing."""
    out = 64 - np.bitwise_count(p[0][:, None] ^ q[0][None, :]).astype(np.int16)
    if not (p[1].all() and q[1].all()):
        out[~(p[1][:, None] & q[1][None, :])] = 0
    return out


def _likeness(raw: np.ndarray) -> np.ndarray:
    return 1.0 - (64 - raw) / 64.0


#: What a measure reads of a column, how it compares two blocks, what it makes of that, which raw value is under all
#: others, the raw value of a measure, and how far raw values of one measure may lie apart.
MEASURES = {"cosine": (_unit, _cosines, _cosine, -np.inf, lambda m: m, 1.1e-6), "hash": (_bits, _agreeing, _likeness, -1, lambda m: m * 64, 1e-6)}


def _asked(queries: DataFrame, q_id: str, columns: list[str], k: int | None = None) -> tuple[DataFrame, int]:
    """The queries that have an id, written once, and the number of blocks they go to the workers in."""
    q = materialize(queries.select(*dict.fromkeys([q_id, *columns])).where(F.col(q_id).isNotNull()), "compared-queries")
    return q, max(1, -(-q.count() // (max(QUERIES, min(4 * QUERIES, LISTED // max(1, k))) if k else QUERIES)))


def _dealt(pool: DataFrame, n_blocks: int) -> DataFrame:
    """The pool for n_blocks readings: a small one over all cores, worked out and dealt once."""
    pool = spread(pool)
    return pool if n_blocks == 1 else materialize(pool, "compared-pool")


def _block(queries: DataFrame, q_id: str, n: int, n_blocks: int) -> pa.Table:
    return queries.where(F.pmod(F.xxhash64(q_id), F.lit(n_blocks)) == n).orderBy(q_id).toArrow()


def _tiles(batches: Iterator[pa.RecordBatch], id_col: str, n_queries: int) -> Iterator[pa.Table]:
    """Rows that have an id, as many at once as TILE pairs allow."""
    rows = max(1, TILE // max(1, n_queries))
    for t in _stacked(batches, ROWS):
        t = t.filter(t.column(id_col).is_valid())
        for lo in range(0, t.num_rows, rows):
            yield t.slice(lo, rows)


def _by_query(q: np.ndarray, value: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order by query, falling value of six digits up to 1, and id: one sort of whole numbers, then one of ties alone."""
    key = q.astype(np.int64) * (1 << 21) - np.rint(value * 1e6).astype(np.int64)
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    tied = np.append(same, False) | np.insert(same, 0, False)
    some = order[tied]
    order[tied] = some[np.lexsort((ids[some], key[some]))]
    return order


def _in_runs(parts: Iterator[tuple]) -> Iterator[list[np.ndarray]]:
    """Arrays of one length each, RUN of them held at a time and given back in order of the last array."""
    held, n = [], 0

    def leave() -> Iterator[list[np.ndarray]]:
        order = np.argsort(held[-1][:n])
        for lo in range(0, n, 1 << 16):
            yield [h[order[lo : lo + (1 << 16)]] for h in held]

    for part in parts:
        held = held or [np.empty(RUN, dtype=x.dtype) for x in part]
        lo = 0
        while lo < len(part[-1]):
            size = min(RUN - n, len(part[-1]) - lo)
            for h, x in zip(held, part, strict=True):
                h[n : n + size] = x[lo : lo + size]
            n, lo = n + size, lo + size
            if n == RUN:
                yield from leave()
                n = 0
    if n:
        yield from leave()


def _without_own(grid: np.ndarray, ids: np.ndarray, own: np.ndarray, least) -> np.ndarray:
    """The grid with `least` where a row meets the query of its own id; own is in order."""
    lo, hi = np.searchsorted(own, ids, side="left"), np.searchsorted(own, ids, side="right")
    for r in np.flatnonzero(hi > lo):
        grid[r, lo[r] : hi[r]] = least
    return grid


def compared(queries: DataFrame, pool: DataFrame, q_id: str, id_col: str, columns: dict[str, tuple[str, str]], score, k: int | None = None, floor: float | None = None, measure: str = "cosine", carry: tuple[str, ...] = (), rough=None, between: tuple[str, str] | None = None, dealt: bool = False, shown=None) -> DataFrame:
    """(q_id, carried columns of the queries, id_col, carried columns of the pool, the columns' measures, score) of pool
    rows other than the query's own: the k best of each query by score, ties to smaller ids, and not under `floor`, nor
    outside [lower, upper) where `between` names two such columns of the queries.

    columns maps a name to a query column and a pool column; score is the name of the one that is the score (there is no
    score column then), or a function of the dictionary of their measures that must round what it returns. rough is a
    function of the dictionary of raw values (cosines; equal bits) that orders pairs just as a score that is a function
    does, and spares working the score out for pairs that cannot be among the k best. Pool rows are compared in tiles by
    one matrix product each; a task keeps its best k of every query and passes over what does not reach the last of
    them, so no pair becomes a row unless it may be in the result. Queries are taken to the workers in blocks of bounded
    size, each running against the whole pool; what is found is not written between. carry names columns of either side;
    a query's must differ in name from the pool's. dealt says that the pool is over all cores as it is.

    shown is a function of the dictionary of ids, carried columns (NaN for NULL) and measures, as arrays over pairs. The
    result then is (q_id, id_col, score) with what it returns as the score, and the rows leave a task in order of it, RUN
    at a time: where all pairs from a floor on are written, equal scores in a row take a fraction of the room.
    """
    read, compare, finish, least, raw_of, slack = MEASURES[measure]
    named = isinstance(score, str)
    if rough and (named or floor is not None or between):
        raise ValueError("rough goes with a score that is a function, and without bounds")
    if shown and (k is not None or not named):
        raise ValueError("shown goes with a score that is a column's measure, and without k")
    q_carry, p_carry = [c for c in carry if c in queries.columns], [c for c in carry if c not in queries.columns]
    queries, n_blocks = _asked(queries, q_id, [*q_carry, *(between or ()), *(a for a, _ in columns.values())], k)
    pool = pool.select(id_col, *p_carry, *dict.fromkeys(b for _, b in columns.values()))
    pool = pool if dealt else _dealt(pool, n_blocks)
    kind_of = lambda df, c: f"`{c}` {df.schema[c].dataType.simpleString()}"
    kinds = [*(kind_of(queries, c) for c in (q_id, *q_carry)), *(kind_of(pool, c) for c in (id_col, *p_carry)), *(f"`{c}` double" for c in columns), *([] if named else ["score double"])]
    names = [q_id, *q_carry, id_col, *p_carry, *columns, *([] if named else ["score"])]
    by = score if named else "score"
    if shown:
        kinds, names = [kind_of(queries, q_id), kind_of(pool, id_col), "score double"], [q_id, id_col, "score"]

    def run_with(block: pa.Table):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = {n: read(block.column(a).combine_chunks()) for n, (a, _) in columns.items()}
            own, n_q = block.column(q_id).to_numpy(), block.num_rows
            lower, upper = (block.column(c).to_numpy() for c in between) if between else (None, None)
            held: list[pa.Table] = []
            bar = last = last_id = None  # of every query: the raw value, score and id of its k-th best so far
            single = None  # the queries' unit vectors in single precision, where one product can tell what reaches a bar
            if k is not None and named and measure == "cosine" and len(columns) == 1 and not between and n_q and (asked[score][1] == asked[score][1][0]).all():
                single = np.ascontiguousarray(asked[score][0].T, dtype=np.float32)

            def sought(mine: dict) -> tuple | None:
                """The pairs that reach the bars, where there are bars and all vectors are of one length."""
                if single is None or bar is None or not (mine[score][1] == asked[score][1][0]).all():
                    return None
                return _reaching(mine[score][0], asked[score][0], single, bar - slack)

            def found(t: pa.Table):
                ids = t.column(id_col).to_numpy()
                mine = {n: read(t.column(b).combine_chunks()) for n, (_, b) in columns.items()}
                got = sought(mine)
                if got:
                    row, q, raw = got
                    keep = ids[row] != own[q]
                else:
                    grids = {n: compare(mine[n], asked[n]) for n in ([score] if named else columns)}
                    grid = grids[score] if named else rough(grids) if rough else score({n: finish(g) for n, g in grids.items()})
                    under, give = (least, slack if named else 0) if named or rough else (-np.inf, 0)
                    grid = _without_own(grid, ids, own, under)
                    ok = grid > under
                    if floor is not None:
                        ok &= grid >= (raw_of(floor) - give if named else floor)
                    if between:
                        ok &= (grid >= raw_of(lower) - give) & (grid <= raw_of(upper) + give)
                    if k is not None and bar is not None:
                        ok &= grid >= bar - give
                    elif k is not None and len(ids) > k:
                        ok &= grid >= np.partition(grid, len(ids) - k, axis=0)[len(ids) - k] - give
                    row, q = np.divmod(np.flatnonzero(ok), n_q)
                    raw, keep = grid[row, q], np.ones(len(q), dtype=bool)
                if named:
                    parts = {score: finish(raw)}
                    for n in [n for n in columns if n != score]:
                        parts[n] = finish(compare(mine[n], asked[n])[row, q])
                    value = parts[score]
                else:
                    parts = {n: finish(g[row, q]) for n, g in grids.items()}
                    value = score(parts) if rough else raw
                if floor is not None:
                    keep &= value >= floor
                if between:
                    keep &= (value >= lower[q]) & (value < upper[q])
                if k is not None and bar is not None:
                    keep &= (value > last[q]) | ((value == last[q]) & (ids[row] < last_id[q]))
                if not keep.all():
                    row, q, raw, value, parts = row[keep], q[keep], raw[keep], value[keep], {n: v[keep] for n, v in parts.items()}
                if shown:
                    carried = {c: block.column(c).to_numpy()[q] for c in q_carry} | {c: t.column(c).to_numpy()[row] for c in p_carry}
                    return q.astype(np.int32), ids[row], shown({q_id: own[q], id_col: ids[row], **carried, **parts})
                at, qa = pa.array(row), pa.array(q)
                cols = [t.column(c).take(at) for c in (id_col, *p_carry)]
                cols += [*(pa.array(parts[n]) for n in columns), *([] if named else [pa.array(value)])]
                got = pa.table([*cols, qa, pa.array(raw)], names=[*names[1 + len(q_carry) :], "__q", "__raw"])
                return with_queries(got) if k is None else got

            def with_queries(t: pa.Table) -> pa.Table:
                """What is kept of pairs, beside what their queries give."""
                mine = [block.column(c).take(t.column("__q")) for c in (q_id, *q_carry)]
                return pa.table([*mine, *t.columns[:-2]], names=names)

            def shrink(parts: list[pa.Table]) -> pa.Table:
                nonlocal bar, last, last_id
                t = pa.concat_tables(parts)
                q, value, ids, raw = (t.column(c).to_numpy() for c in ("__q", by, id_col, "__raw"))
                order = _by_query(q, value, ids) if named and measure == "cosine" else np.lexsort((ids, -value, q))
                at, sorted_q = np.arange(len(order)), q[order]
                place = at - np.maximum.accumulate(np.where(np.diff(sorted_q, prepend=-1) != 0, at, 0))
                full = order[place == k - 1]
                if len(full):
                    if bar is None:
                        bar, last, last_id = np.full(n_q, least if named or rough else -np.inf, dtype=raw.dtype), np.full(n_q, -np.inf), np.zeros(n_q, dtype=ids.dtype)
                    bar[q[full]], last[q[full]], last_id[q[full]] = raw[full], value[full], ids[full]
                return t.take(pa.array(order[place < k]))

            if not n_q:
                return
            if shown:
                for part in _in_runs(found(t) for t in _tiles(batches, id_col, n_q)):
                    cols = [pa.array(own[part[0]], type=block.schema.field(q_id).type), pa.array(part[1]), pa.array(part[2])]
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                return
            for t in _tiles(batches, id_col, n_q):
                got = found(t)
                if k is None:
                    yield from got.combine_chunks().to_batches(max_chunksize=20_000)
                elif got.num_rows:
                    held.append(got)
                    held = [shrink(held)] if sum(h.num_rows for h in held) > 2 * k * n_q else held
            if held:
                yield from with_queries(shrink(held)).combine_chunks().to_batches(max_chunksize=20_000)

        return run

    out = None
    for n in range(n_blocks):
        got = pool.mapInArrow(run_with(_block(queries, q_id, n, n_blocks)), ", ".join(kinds))
        out = got if out is None else out.unionByName(got)
    return out if k is None else first_per_key(out, [q_id], F.desc(by), F.col(id_col), k=k, rank="rank")


def best_by_label(queries: DataFrame, pool: DataFrame, q_id: str, q_vec: str, id_col: str, vec: str, label: str) -> DataFrame:
    """(q_id, label, best): the highest cosine of each query with a row of each label other than the query's own row. A
    task keeps one number a query and label, so no pair becomes a row."""
    queries, n_blocks = _asked(queries, q_id, [q_vec])
    pool = _dealt(pool.select(id_col, label, vec), n_blocks)
    kinds = f"`{q_id}` {queries.schema[q_id].dataType.simpleString()}, `{label}` {pool.schema[label].dataType.simpleString()}, best double"

    def run_with(block: pa.Table):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = _unit(block.column(q_vec).combine_chunks())
            own, n_q = block.column(q_id).to_numpy(), block.num_rows
            best: dict = {}

            def leave() -> Iterator[pa.RecordBatch]:
                for name, top in best.items():
                    q = np.flatnonzero(top > -np.inf)
                    cols = [block.column(q_id).take(pa.array(q)), pa.array([name] * len(q), type=pool_kind), pa.array(_cosine(top[q]))]
                    yield from pa.table(cols, names=[q_id, label, "best"]).combine_chunks().to_batches()
                best.clear()

            if not n_q:
                return
            for t in _tiles(batches, id_col, n_q):
                pool_kind = t.schema.field(label).type
                grid = _without_own(_cosines(_unit(t.column(vec).combine_chunks()), asked), t.column(id_col).to_numpy(), own, -np.inf)
                coded = t.column(label).combine_chunks().dictionary_encode(null_encoding="encode")
                codes = coded.indices.to_numpy()
                order = np.argsort(codes, kind="stable")
                starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
                tops = np.maximum.reduceat(grid[order], starts, axis=0)
                for code, top in zip(codes[order][starts], tops, strict=True):
                    name = coded.dictionary[int(code)].as_py()
                    best[name] = np.maximum(best[name], top) if name in best else top
                if len(best) * n_q > KEPT:
                    yield from leave()
            yield from leave()

        return run

    out = None
    for n in range(n_blocks):
        got = pool.mapInArrow(run_with(_block(queries, q_id, n, n_blocks)), kinds)
        out = got if out is None else out.unionByName(got)
    return out.groupBy(q_id, label).agg(F.max("best").alias("best"))


def _stacked(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches joined into, and cut down to, tables of about `rows` rows."""
    held, n = [], 0
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            held.append(b.slice(lo, rows))
            n += held[-1].num_rows
            if n >= rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def knn(queries: DataFrame, pool: DataFrame, k: int, q_id: str = "query_id", q_vec: str = "query_vec", id_col: str = "vec_id", vec: str = "embedding", floor: float = 0.0) -> DataFrame:
    """(query_id, id, sim, rank): each query's k most similar rows but itself, at least `floor`; ties to smaller ids."""
    got = compared(queries, pool, q_id, id_col, {"sim": (q_vec, vec)}, "sim", k=k, floor=floor)
    return got.select(q_id, id_col, "sim", "rank")


def best_of_few(rows: DataFrame, few: DataFrame, most: int = 10_000) -> DataFrame:
    """Every row beside every row of a side of few rows (labels, centres), which is counted first: more than `most` is an error."""
    if few.limit(most + 1).count() > most:
        raise ValueError(f"the small side has more than {most} rows")
    return rows.join(F.broadcast(few.withColumn("__one", F.lit(1))), F.lit(1) == F.col("__one")).drop("__one")


def with_margin(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The winner of every key, its runner-up's score and the margin between them."""
    w = W.partitionBy(*keys).orderBy(F.desc(score), tie)
    got = df.withColumn("__n", F.row_number().over(w)).withColumn("runner_up", F.lead(score).over(w))
    return got.where("__n = 1").drop("__n").withColumn("margin", F.round(F.col(score) - F.coalesce("runner_up", F.lit(0.0)), 6))


def capped(df: DataFrame, mandatory: Column, cap: int, *order: Column | str) -> DataFrame:
    """All mandatory rows, then the best others while there is room."""
    must = df.where(mandatory)
    room = max(0, cap - must.count())
    return must.unionByName(df.where(~F.coalesce(mandatory, F.lit(False))).orderBy(*order).limit(room))


def adaptive_k(k: int, total: int, step: int = 800) -> int | None:
    """Next size of an expanding search: max(2k, k + step) up to the total; None at the end."""
    return None if k >= total else min(total, max(2 * k, k + step))


def should_stop(new_ids: int, median: float | None, tail: float | None, relevant: int, best: float, floor: float, ratio: float = 0.72) -> str:
    """Why an expansion ends: nothing new, a median under `ratio` of the tail before, or fewer than three relevant rows
    none of which reaches max(.55, floor); empty while it goes on."""
    if new_ids <= 0:
        return "no_new_ids"
    if tail and median is not None and median < ratio * tail:
        return "similarity_drop"
    return "low_yield" if relevant < 3 and best < max(0.55, floor) else ""


def _bands(queries: DataFrame, pool: DataFrame, q_id: str, q_vec: str, id_col: str, vec: str) -> DataFrame:
    """(q_id, band, n, through): how many rows but its own lie in each band of a query's similarity, BINS to one, and in it
    and the bands above."""
    queries, n_blocks = _asked(queries, q_id, [q_vec])
    kind = queries.schema[q_id].dataType.simpleString()

    def run_with(block: pa.Table):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = _unit(block.column(q_vec).combine_chunks())
            own, n_q = block.column(q_id).to_numpy(), block.num_rows
            if not n_q:
                return
            counts, first = np.zeros((n_q, BINS + 2), dtype=np.int64), np.arange(n_q, dtype=np.int64) * (BINS + 2)
            for t in _tiles(batches, id_col, n_q):
                sims = _cosine(_cosines(_unit(t.column(vec).combine_chunks()), asked))
                at = _without_own(np.floor(sims * BINS).astype(np.int64), t.column(id_col).to_numpy(), own, BINS + 1)
                counts += np.bincount((at + first).ravel(), minlength=counts.size).reshape(counts.shape)
            q, band = np.nonzero(counts[:, : BINS + 1])
            yield from pa.table([block.column(q_id).take(pa.array(q)), pa.array(band.astype(np.int32)), pa.array(counts[q, band])], names=[q_id, "band", "n"]).combine_chunks().to_batches(max_chunksize=20_000)

        return run

    out = None
    for n in range(n_blocks):
        got = pool.mapInArrow(run_with(_block(queries, q_id, n, n_blocks)), f"`{q_id}` {kind}, band int, n long")
        out = got if out is None else out.unionByName(got)
    out = out.groupBy(q_id, "band").agg(F.sum("n").alias("n"))
    return out.withColumn("through", F.sum("n").over(W.partitionBy(q_id).orderBy(F.desc("band"))))


def expanding(queries: DataFrame, pool: DataFrame, k: int, floor: float, q_id: str = "query_id", q_vec: str = "query_vec", id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, id, sim, rank, round, why): neighbours by a search that widens, k, then max(2k, k + 800), and so on, for
    the queries whose last step was worth it, up to the whole pool; `why` says what ended a query's search. Only one row a
    query comes to the driver's decision, as an aggregate that stays a frame.

    How many rows of each query lie in each of BINS bands of similarity is counted once; a step then lets out only rows
    of the bands that its ranks lie in, and numbers them from the rows in the bands above. A step's median is read at the
    middle ranks that the counts give, so that no query's values are held together."""
    total, size, done = pool.count(), k, 0
    active, out, step = queries.select(q_id, q_vec), None, 0
    pool = materialize(spread(pool.select(id_col, vec)), "expansion-pool")
    bands = materialize(_bands(active, pool, q_id, q_vec, id_col, vec), "expansion-bands")
    tail = None
    while True:
        size = min(size, total)
        step += 1
        mine = bands.join(active.select(q_id), q_id, "left_semi").where((F.col("through") > done) & (F.col("through") - F.col("n") < size))
        span = mine.groupBy(q_id).agg((F.min("band") / BINS).alias("__lo"), ((F.max("band") + 1) / BINS).alias("__hi"), F.min(F.col("through") - F.col("n")).alias("__above"), (F.least(F.max("through"), F.lit(size)) - done).alias("__n"))
        near = compared(active.join(span, q_id), pool, q_id, id_col, {"sim": (q_vec, vec)}, "sim", between=("__lo", "__hi"), carry=("__above", "__n"), dealt=True)
        rank = (F.col("__above") + F.row_number().over(W.partitionBy(q_id).orderBy(F.desc("sim"), F.col(id_col)))).cast("int")
        middle = F.floor((F.col("__n") + 1) / 2) == F.col("rank") - done, F.floor((F.col("__n") + 2) / 2) == F.col("rank") - done
        new = near.withColumn("rank", rank).where((F.col("rank") > done) & (F.col("rank") <= size)).withColumn("__middle", middle[0] | middle[1])
        new = materialize(new.drop("__above", "__n"), "expansion")
        seen = new.drop("__middle").withColumn("round", F.lit(step))
        out = seen if out is None else out.unionByName(seen)
        per = new.groupBy(q_id).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("__middle"), F.col("sim"))).alias("median"), F.min("sim").alias("last"), F.sum((F.col("sim") >= floor).cast("int")).alias("relevant"), F.max("sim").alias("best"))
        per = active.select(q_id).join(per, q_id, "left").fillna(0, ["n", "relevant"])
        per = per.join(tail, q_id, "left") if tail is not None else per.withColumn("tail", F.lit(None).cast("double"))
        why = (
            F.when(F.col("n") == 0, "no_new_ids").when((F.col("tail") > 0) & (F.col("median") < 0.72 * F.col("tail")), "similarity_drop")
            .when((F.col("relevant") < 3) & (F.coalesce("best", F.lit(0.0)) < max(0.55, floor)), "low_yield").when(F.lit(size >= total), "whole_pool")
        )
        state = materialize(per.select(q_id, why.alias("why"), F.col("last").alias("tail")), "expansion-state")
        ended = state.where("why is not null").select(q_id, "why")
        stops = ended if step == 1 else stops.unionByName(ended)
        active = materialize(active.join(state.where("why is null").select(q_id), q_id, "left_semi"), "expansion-queries")
        tail = state.where("why is null").select(q_id, "tail")
        done, size = size, adaptive_k(size, total) or size
        if not active.take(1):
            return out.join(stops, q_id, "left").select(q_id, id_col, "sim", "rank", "round", "why")
