"""Registered queries of the enumeration operators and the SQL that they are checked against.

States come from ``lineitem``: a number made of three of its keys, cut to the
board's bits.  The SQL is written from the boards' geometry alone (VALUES of
jumps, sums of shifted bits) and reduces children in full, so it shares no step
with the expressions under test.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boards import BOARDS, Board
from .functions import bitboard, gf2, tables, units
from .functions.ranks import Ranks, with_rank, with_state
from .operators import kernel, keys, routing
from .plans.enumeration import Enumerator, sample_manifest
from .sources import footers, key_files
from .sources.files import drop_at_end, shared_root
from .sources.rounds import RoundStore, file_sizes
from .streaming.trickle import user_totals

FLAGSHIP = "frontier_step"
_SMALL = BOARDS["cross33"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _folder(spark: SparkSession, label: str) -> str:
    """A new folder that goes when the driver ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    drop_at_end(spark, path)
    return path


def _numbers(spark: SparkSession, sf_dir: str, board: Board = _SMALL, extra: int = 0, where: str = "true") -> DataFrame:
    """(state): states made from lineitem, with repetitions; ``extra`` more bits than the board has."""
    number = (F.col("l_orderkey") % 1000003) * F.lit(2147483647) + F.col("l_partkey") * 65537 + F.col("l_linenumber") * 8191
    mask = (1 << (board.size + extra)) - 1
    return _table(spark, sf_dir, "lineitem").where(where).select(number.bitwiseAND(F.lit(mask)).alias("state"))


def _states(spark: SparkSession, sf_dir: str, board: Board = _SMALL, extra: int = 0, where: str = "true") -> DataFrame:
    """(state): the same, each once."""
    return _numbers(spark, sf_dir, board, extra, where).distinct()


def _children(spark: SparkSession, sf_dir: str, board: Board = _SMALL) -> DataFrame:
    """(state, moves): canonical children of all states, once each, and the jumps that lead to them."""
    return kernel.step(kernel.distinct(_numbers(spark, sf_dir, board), board.size), board)


def _state_sql(board: Board = _SMALL, extra: int = 0, where: str = "true", name: str = "st") -> str:
    mask = (1 << (board.size + extra)) - 1
    return f"{name} AS (SELECT DISTINCT (((l_orderkey % 1000003) * 2147483647 + l_partkey * 65537 + l_linenumber * 8191) & {mask}) AS state FROM lineitem WHERE {where})"


def _closure_sql() -> str:
    """Full images of all states on all boards, and their parities."""
    parts = []
    for name, b in BOARDS.items():
        for t in range(8):
            parts.append(f"SELECT '{name}' AS board, {t} AS symmetry, syndrome, {_parities_sql('image', b)} AS image FROM (SELECT {_parities_sql('state', b)} AS syndrome, {_image_sql('state', b, t)} AS image FROM {name})")
    states = ", ".join(_state_sql(b, name=name) for name, b in BOARDS.items())
    return f"WITH {states}, i AS ({' UNION ALL '.join(parts)}) SELECT board, symmetry::BIGINT AS symmetry, syndrome, image, count(*) AS states FROM i GROUP BY ALL"


def _jumps_sql(board: Board) -> str:
    rows = ", ".join(f"({i}, {o}::BIGINT, {d}::BIGINT, {c}::BIGINT)" for i, (o, d, c) in enumerate(board.jumps))
    return f"jumps(jump, occ, dst, chg) AS (VALUES {rows})"


def _image_sql(column: str, board: Board, t: int) -> str:
    return "(" + " + ".join(f"((({column} >> {a}) & 1) << {b})" for a, b in enumerate(board.permutations[t])) + ")"


def _canonical_sql(column: str, board: Board) -> str:
    return "least(" + ", ".join(_image_sql(column, board, t) for t in range(8)) + ")"


def _children_sql(board: Board) -> str:
    """CTEs up to ch(state, jump, child): children that aren't reduced yet."""
    return f"WITH {_state_sql(board)}, {_jumps_sql(board)}, ch AS (SELECT state, jump, xor(state, chg) AS child FROM st JOIN jumps ON (state & occ) = occ AND (state & dst) = 0)"


def _parities_sql(column: str, board: Board = _SMALL) -> str:
    return "(" + " + ".join(f"((bit_count({column} & {m})::BIGINT & 1) << {i})" for i, m in enumerate(board.parity_masks)) + ")"


_MIX_SQL = "WITH k AS (SELECT DISTINCT l_orderkey AS key FROM lineitem), a AS (SELECT key, {x} AS x FROM k), "
_MIX_SQL += ", ".join(
    f"{new} AS (SELECT key, ((xor({c}, {c} >> 33)::HUGEINT * {f & 0xFFFFFFFF}::HUGEINT + (((xor({c}, {c} >> 33) & 4294967295)::HUGEINT * {f >> 32}::HUGEINT) % 4294967296::HUGEINT) * 4294967296::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT AS x FROM {old})"
    for old, new, c, f in (("a", "b", "x", 0xFF51AFD7ED558CCD), ("b", "c", "x", 0xC4CEB9FE1A85EC53))
)
_MIX_SQL += ", m AS (SELECT key, xor(x, x >> 33) AS h FROM c)"


def frontier_step(board: Board):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Children of all states, once each, by their number of pegs: states and jumps that lead to them."""
        return _children(spark, sf_dir, board).groupBy(bitboard.population(F.col("state")).alias("population")).agg(F.count(F.lit(1)).alias("states"), F.sum("moves").alias("moves"))

    sql = f"{_children_sql(board)}, d AS (SELECT {_canonical_sql('child', board)} AS c FROM ch) SELECT bit_count(c)::BIGINT AS population, count(DISTINCT c) AS states, count(*) AS moves FROM d GROUP BY 1"
    return query, sql


def state_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = _states(spark, sf_dir).select("state", bitboard.decode(F.col("state"), _SMALL).alias("pegs"))
    return holes.select("state", bitboard.encode(F.col("pegs")).alias("encoded"), F.size(F.filter("pegs", lambda p: p)).cast("long").alias("pegs"), F.element_at("pegs", 1).cast("long").alias("first_hole"))


def state_legal_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel.successors(_states(spark, sf_dir), _SMALL).groupBy("state").agg(F.count(F.lit(1)).alias("moves"))


def state_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel.successors(_states(spark, sf_dir), _SMALL).select("state", F.col("jump").cast("long").alias("jump"), "child")


def state_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).select("state", *(c.alias(f"t{t}") for t, c in enumerate(bitboard.transforms(F.col("state"), _SMALL))))


def state_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).select("state", bitboard.canonical(F.col("state"), _SMALL).alias("canonical"))


def state_canonical_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel.children(_states(spark, sf_dir), _SMALL)


def state_expand_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Arrow form of the expansion, all repetitions summed."""
    return _children(spark, sf_dir)


def state_population_syndrome(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("state")
    n = bitboard.population(s)
    return _states(spark, sf_dir).select("state", n.alias("population"), bitboard.syndrome(s, _SMALL).alias("syndrome"), F.greatest(F.lit(0).cast("long"), n - 1).alias("next_population"))


def state_invariant_after_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By parity class: children, and those that keep the class and have one peg less (all should)."""
    s, c = F.col("state"), F.col("child")
    kept = (bitboard.syndrome(s, _SMALL) == bitboard.syndrome(c, _SMALL)) & (bitboard.population(c) == bitboard.population(s) - 1)
    return kernel.successors(_states(spark, sf_dir), _SMALL).groupBy(bitboard.syndrome(s, _SMALL).alias("syndrome")).agg(F.count(F.lit(1)).alias("children"), F.sum(kept.cast("long")).alias("kept"))


def state_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _states(spark, sf_dir, extra=2)
    return found.groupBy(bitboard.is_valid(F.col("state"), _SMALL).cast("long").alias("valid")).agg(F.count(F.lit(1)).alias("states"))


def frontier_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children by number of pegs, the factor to the class with one peg more, and the ratio of neighbouring factors."""
    from pyspark.sql import Window

    counts = frontier_step(_SMALL)[0](spark, sf_dir).select("population", "states")
    order = Window.orderBy(F.desc("population"))  # a row for each number of pegs
    grown = counts.withColumn("factor", F.col("states") / F.lag("states").over(order))
    return grown.select("population", "states", F.round("factor", 9).alias("factor"), F.round(F.col("factor") / F.lag("factor").over(order), 9).alias("ratio"))


def frontier_stats_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States by number of pegs and in all (population -1)."""
    found = _states(spark, sf_dir).select(bitboard.population(F.col("state")).alias("population"))
    return found.rollup("population").agg(F.count(F.lit(1)).alias("states")).select(F.coalesce("population", F.lit(-1)).cast("long").alias("population"), "states")


def frontier_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States without a legal jump."""
    states = _states(spark, sf_dir)
    jumps = F.broadcast(kernel.jumps_table(spark, _SMALL).select("occupied", "target"))
    return states.join(jumps, bitboard.is_legal(F.col("state"), F.col("occupied"), F.col("target")), "left_anti")


def round_publish_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round made of the states is published, advanced from disk by the enumerator, and counted again."""
    enumerator = Enumerator(spark, _SMALL, _folder(spark, "rounds"), verify=True)
    store = enumerator.store
    store.files.make_root()
    written = store.write(1, _states(spark, sf_dir), max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    store.publish(1, sample_manifest(written, _SMALL.size))
    enumerator.run_one_round()
    parts = [store.read(n).select(F.lit(n).cast("long").alias("round")) for n in store.completed()]
    return parts[0].unionByName(parts[1]).groupBy("round").agg(F.count(F.lit(1)).alias("states"))


def forecast_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries of 128 ranges for the children of all states, from the children of a sample of them."""
    sample = keys.ordinal_sample(_states(spark, sf_dir), "state")
    return routing.forecast_bounds(sample, _SMALL)


def forecast_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How evenly the children of all states, once each, fall into the forecast ranges."""
    # numbered and written once, for the sample and for the step
    placed = keys.with_ordinal(kernel.distinct(_numbers(spark, sf_dir), _SMALL.size), "state")
    bounds = sorted(r["bound"] for r in routing.forecast_bounds(keys.sample_of(placed, "state"), _SMALL).collect())  # at most 127
    made = kernel.step(placed, _SMALL)
    found = keys.shard_counts(made, bitboard.shard(F.col("state"), bounds), len(bounds) + 1)
    return keys.shard_balance(found).select("largest", F.round("mean", 6).alias("mean"), F.round("ratio", 6).alias("ratio"), "empty")


def _stored(spark: SparkSession, states: DataFrame, label: str) -> RoundStore:
    """A store whose round 1 is in progress with these states, in as many ranges as there are shuffle partitions."""
    store = RoundStore(spark, _folder(spark, label))
    store.files.make_root()
    store.write(1, states, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    store.files.rename("1.in-progress", "1")
    return store


def round_footer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states as a round's files: count, least and greatest key from the footers, and neighbouring row groups out of order."""
    store = _stored(spark, _states(spark, sf_dir), "footers")
    found = footers.footers(spark, store.files.at("1"))
    bounds = found.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("states"), F.min("first").alias("least"), F.max("last").alias("greatest"))
    weights = footers.summary(found, keys.SAMPLE).agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("summary_weight"))
    return bounds.crossJoin(weights).crossJoin(footers.disorder(found))  # one row each


def round_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of returned items against those of items with an even line number, compared as two rounds' files."""
    parts = [_stored(spark, _states(spark, sf_dir, where=w), "compared") for w in ("l_returnflag = 'R'", "l_linenumber % 2 = 0")]
    return footers.key_differences(spark, *(store.files.at("1") for store in parts))


def key_files_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of line items, written as key files and read again."""
    path = _folder(spark, "keys")
    key_files.write_key_files(_keys(spark, sf_dir, "lineitem", "l_orderkey").distinct(), path, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return key_files.read_key_files(spark, path, bits=63)


#: Bits of the states whose ranks are compared with places among all words of so many bits.
_RANK_BITS = 16


def state_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16 lowest holes of each state: place among all patterns of its number of pegs and parities, and the pattern made from that again."""
    ranks = Ranks(_RANK_BITS, _SMALL.parity_masks)
    low = _states(spark, sf_dir).select(F.col("state").bitwiseAND(F.lit((1 << _RANK_BITS) - 1)).alias("state")).distinct()
    return with_state(with_rank(low, ranks), ranks, "again")


def state_rank_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By board and number of pegs: states, and those that come back from their ranks (all should)."""
    out = None
    for name, board in BOARDS.items():
        ranks = Ranks.of(board)
        found = with_state(with_rank(_states(spark, sf_dir, board), ranks), ranks, "again")
        kept = F.sum((F.col("state") == F.col("again")).cast("long"))
        found = found.groupBy(F.lit(name).alias("board"), "population").agg(F.count(F.lit(1)).alias("states"), kept.alias("kept"))
        out = found if out is None else out.unionByName(found)
    return out


def state_class_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By board, symmetry and parity class: the class of the states' images, by the symmetry's map of classes alone, and states."""
    out = None
    for name, board in BOARDS.items():
        own = _states(spark, sf_dir, board).groupBy(bitboard.syndrome(F.col("state"), board).alias("syndrome")).agg(F.count(F.lit(1)).alias("states"))
        for t in range(8):
            found = own.select(F.lit(name).alias("board"), F.lit(t).cast("long").alias("symmetry"), "syndrome", gf2.image_class(F.col("syndrome"), board, t).alias("image"), "states")
            out = found if out is None else out.unionByName(found)
    return out


def successors_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every legal jump of every state by the table function."""
    tables.register(spark)
    _states(spark, sf_dir).createOrReplaceTempView("stateloom_states")
    return spark.sql("SELECT state, jump, child FROM successors(TABLE(SELECT state FROM stateloom_states), 'cross33')")


def _keys(spark: SparkSession, sf_dir: str, table: str, column: str) -> DataFrame:
    return _table(spark, sf_dir, table).select(F.col(column).cast("long").alias("key"))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir, "lineitem", "l_orderkey").distinct().withColumn("h", bitboard.mix64(F.col("key")))


def key_hash_mix64(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("h", 32)
    return _mixed(spark, sf_dir).select("key", low.alias("low32"), high.alias("high32"), low.bitwiseXOR(high).alias("folded"))


def key_prefix_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of 128 shards by the folded hash of a key's prefix (keys have 32 bits here, so 25 are kept)."""
    h = bitboard.mix64(bitboard.prefix(F.col("key"), 32))
    found = _keys(spark, sf_dir, "lineitem", "l_orderkey").distinct().withColumn("h", h)
    return keys.shard_counts(found, F.col("h").bitwiseXOR(F.shiftrightunsigned("h", 32)).bitwiseAND(F.lit(127)), 128)


def keys_distinct_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.with_ordinal(_keys(spark, sf_dir, "lineitem", "l_partkey").distinct()).select("key", "ordinal")


def keys_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir, "orders", "o_orderkey").union(_keys(spark, sf_dir, "lineitem", "l_orderkey")).distinct()


def keys_except_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.differences(_keys(spark, sf_dir, "lineitem", "l_partkey"), _keys(spark, sf_dir, "lineitem", "l_suppkey"))


def keys_recent_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of line items that no urgent order has, once each."""
    seen = _table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("key"))
    return _keys(spark, sf_dir, "lineitem", "l_orderkey").distinct().join(seen, "key", "left_anti")


def keys_ordinal_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.ordinal_sample(_keys(spark, sf_dir, "orders", "o_orderkey").distinct())


def keys_increasing_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("place"), F.col("o_custkey").alias("key"))
    return keys.is_increasing(rows, "place")


def keys_gap_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.gaps(_keys(spark, sf_dir, "lineitem", "l_partkey"))


def quantile_bounds_unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.quantile_bounds(_keys(spark, sf_dir, "orders", "o_custkey"))


def quantile_bounds_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.weighted_bounds(_keys(spark, sf_dir, "orders", "o_custkey").withColumn("weight", F.lit(1)))


_BOUNDS = [7, 50, 51, 400, 1500, 9000]


def shard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _keys(spark, sf_dir, "lineitem", "l_partkey").distinct()
    return found.select("key", bitboard.shard(F.col("key"), _BOUNDS).cast("long").alias("shard"))


def shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keys.shard_counts(_keys(spark, sf_dir, "lineitem", "l_partkey"), bitboard.shard(F.col("key"), _BOUNDS), 128)
    return keys.shard_balance(found).select("largest", F.round("mean", 6).alias("mean"), F.round("ratio", 6).alias("ratio"), "empty")


def batch_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and first key of batches of 4096 keys in order."""
    placed = keys.with_ordinal(_keys(spark, sf_dir, "orders", "o_orderkey"))
    return placed.groupBy(F.floor(F.col("ordinal") / 4096).cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("first_key"))


def summary_from_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.summary(_keys(spark, sf_dir, "orders", "o_orderkey").distinct())


_NAME_SQL = "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.in-progress' WHEN 2 THEN 'x' ELSE '0' END"


def dir_name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of names that are those of finished rounds."""
    name = F.concat((F.col("o_custkey") % 40).cast("string"), F.expr(_NAME_SQL))
    named = _table(spark, sf_dir, "orders").select(name.alias("name")).where(F.col("name").rlike("^[1-9][0-9]*$"))
    return named.groupBy(F.expr("try_cast(name AS BIGINT)").alias("round")).agg(F.count(F.lit(1)).alias("n"))


def throughput_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    found = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), F.min(v).alias("least"), F.max(v).alias("most"))
    return found.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "least", "most")


def unit_maths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type as if each were a state of eight bytes and its value milliseconds: MiB a second, bytes for a state, and the mean's change against all in percent."""
    events = _table(spark, sf_dir, "events")
    ms, n = F.sum("value"), F.count(F.lit(1))
    every = events.agg(F.avg("value").alias("mean_of_all"))
    found = events.groupBy("event_type").agg(ms.alias("ms"), n.alias("states"), F.avg("value").alias("mean")).crossJoin(every)  # one row
    rates = units.mib_per_second(F.col("states") * 8, F.col("ms")), units.bytes_per_state(F.col("states") * 8, F.col("states")), units.percent(F.col("mean_of_all"), F.col("mean"))
    return found.select("event_type", "states", *(F.round(c, 9).alias(name) for c, name in zip(rates, ("mib_per_s", "bytes_per_state", "percent"), strict=True)))


def pair_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quantity of returned against other line items by line number, and whether their ranges overlap."""
    lines = _table(spark, sf_dir, "lineitem")

    def side(rows: DataFrame, s: str) -> DataFrame:
        return rows.groupBy("l_linenumber").agg(F.avg("l_quantity").alias(f"mean_{s}"), F.min("l_quantity").alias(f"lo_{s}"), F.max("l_quantity").alias(f"hi_{s}"))

    both = side(lines.where("l_returnflag = 'R'"), "a").join(side(lines.where("l_returnflag <> 'R'"), "b"), "l_linenumber", "full")
    return both.select(
        F.col("l_linenumber").cast("long").alias("line"),
        F.round((F.col("mean_b") - F.col("mean_a")) / F.col("mean_a") * 100, 6).alias("percent"),
        (F.greatest("lo_a", "lo_b") <= F.least("hi_a", "hi_b")).cast("long").alias("overlap"),
    )


def file_size_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of the tables themselves by suffix."""
    return file_sizes(spark, sf_dir)


def _registered() -> tuple[dict, dict]:
    b = _SMALL
    children = _children_sql(b)
    states = f"WITH {_state_sql(b)}"
    step_sql = frontier_step(b)[1]
    numbered = "WITH k AS (SELECT DISTINCT o_orderkey AS key FROM orders), r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS o, count(*) OVER () AS n FROM k)"
    stride = "(SELECT CASE " + " ".join(f"WHEN ceil(count(*) / {2.0**i}) <= 4096 THEN {2**i}" for i in range(31)) + " END FROM k)"
    case = "CASE " + " ".join(f"WHEN key >= {x} THEN {i}" for i, x in reversed(list(enumerate(_BOUNDS, 1)))) + " ELSE 0 END"
    shards = f"c AS (SELECT {case} AS shard, count(*) AS n FROM k GROUP BY 1), s AS (SELECT range AS shard, coalesce(n, 0) AS n FROM range(128) LEFT JOIN c ON c.shard = range)"
    returned = "l_returnflag = 'R'"
    cuts = "c AS (SELECT key, coalesce(sum(w) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run, sum(w) OVER () AS total, least(127, count(*) OVER () - 1) AS b FROM w), q AS (SELECT key, (SELECT count(*) FROM range(1, 128) t(i) WHERE i <= b AND run >= total * i / (b + 1)) AS q FROM c) SELECT key AS bound FROM (SELECT key, q, lag(q, 1, 0) OVER (ORDER BY key) AS p FROM q) WHERE q > p"
    sampled = f"k AS (SELECT state AS key FROM st), r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS o, count(*) OVER () AS n FROM k), sm AS (SELECT key AS state, least({stride}, n - o) AS weight FROM r WHERE o % {stride} = 0), sc AS (SELECT xor(state, chg) AS child, weight FROM sm JOIN jumps ON (state & occ) = occ AND (state & dst) = 0), w AS (SELECT {_canonical_sql('child', b)} AS key, sum(weight)::DOUBLE AS w FROM sc GROUP BY 1), {cuts}"
    queries: dict = {}
    sql: dict = {}
    for name, chosen in (("frontier_step", b), ("frontier_step_cross37", BOARDS["cross37"]), ("frontier_step_cross49", BOARDS["cross49"])):
        queries[name], sql[name] = frontier_step(chosen)
    for f in (
        state_encode_decode, state_legal_moves, state_successors, state_transforms, state_canonical, state_canonical_children, state_expand_batches,
        state_population_syndrome, state_invariant_after_jump, state_validate, frontier_growth, frontier_stats_total, frontier_terminal, round_publish_resume,
        forecast_bounds, forecast_balance, round_footer_summary, round_differences, key_files_cycle, state_rank, state_rank_cycle, state_class_closure, successors_in_sql,
        key_hash_mix64, key_prefix_shard, keys_distinct_sorted, keys_union_dedup, keys_except_both, keys_recent_antijoin, keys_ordinal_sample,
        keys_increasing_check, keys_gap_bytes, quantile_bounds_unweighted, quantile_bounds_weighted, shard_assign, shard_balance, batch_accounting,
        summary_from_partitions, dir_name_filter, throughput_summary, unit_maths, pair_compare, file_size_report,
    ):
        queries[f.__name__] = f
    queries["stream_user_totals"] = user_totals
    sql |= {
        "state_encode_decode": f"{states} SELECT state, state AS encoded, bit_count(state)::BIGINT AS pegs, state & 1 AS first_hole FROM st",
        "state_legal_moves": f"{children} SELECT state, count(*) AS moves FROM ch GROUP BY 1",
        "state_successors": f"{children} SELECT state, jump::BIGINT AS jump, child FROM ch",
        "state_transforms": f"{states} SELECT state, " + ", ".join(f"{_image_sql('state', b, t)} AS t{t}" for t in range(8)) + " FROM st",
        "state_canonical": f"{states} SELECT state, {_canonical_sql('state', b)} AS canonical FROM st",
        "state_canonical_children": f"{children} SELECT state, {_canonical_sql('child', b)} AS child FROM ch",
        "state_expand_batches": f"{children} SELECT {_canonical_sql('child', b)} AS state, count(*) AS moves FROM ch GROUP BY 1",
        "state_population_syndrome": f"{states} SELECT state, bit_count(state)::BIGINT AS population, {_parities_sql('state')} AS syndrome, greatest(0, bit_count(state)::BIGINT - 1) AS next_population FROM st",
        "state_invariant_after_jump": f"{children} SELECT {_parities_sql('state')} AS syndrome, count(*) AS children, count(*) AS kept FROM ch GROUP BY 1",
        "state_validate": f"WITH {_state_sql(b, 2)} SELECT (state <= {b.full})::BIGINT AS valid, count(*) AS states FROM st GROUP BY 1",
        "frontier_growth": f"WITH f AS ({step_sql}), g AS (SELECT population, states, states / lag(states) OVER (ORDER BY population DESC) AS factor FROM f) SELECT population, states, round(factor, 9) AS factor, round(factor / lag(factor) OVER (ORDER BY population DESC), 9) AS ratio FROM g",
        "frontier_stats_total": f"{states}, c AS (SELECT bit_count(state)::BIGINT AS population, count(*) AS states FROM st GROUP BY 1) SELECT * FROM c UNION ALL SELECT -1, count(*) FROM st",
        "frontier_terminal": f"{children} SELECT state FROM st WHERE state NOT IN (SELECT state FROM ch)",
        "round_publish_resume": f"{children} SELECT 1::BIGINT AS round, count(*) AS states FROM st UNION ALL SELECT 2, count(DISTINCT {_canonical_sql('child', b)}) FROM ch",
        "forecast_bounds": f"WITH {_state_sql(b)}, {_jumps_sql(b)}, {sampled}",
        "forecast_balance": f"{children}, every AS (SELECT DISTINCT {_canonical_sql('child', b)} AS child FROM ch), bnd AS (WITH {sampled}), p AS (SELECT (SELECT count(*) FROM bnd WHERE bound <= child) AS shard FROM every), n AS (SELECT shard, count(*) AS n FROM p GROUP BY 1), s AS (SELECT range AS shard, coalesce(n, 0) AS n FROM range((SELECT count(*) + 1 FROM bnd)) LEFT JOIN n ON n.shard = range) SELECT max(n) AS largest, round(avg(n), 6) AS mean, round(max(n) / avg(n), 6) AS ratio, sum((n = 0)::BIGINT)::BIGINT AS empty FROM s",
        "round_footer_summary": f"{states} SELECT count(*) AS states, min(state) AS least, max(state) AS greatest, count(*) AS summary_weight, 0::BIGINT AS faults FROM st",
        "round_differences": f"WITH {_state_sql(b, where=returned, name='a')}, {_state_sql(b, where='l_linenumber % 2 = 0', name='z')} SELECT state AS key, 'left' AS side FROM a WHERE state NOT IN (SELECT state FROM z) UNION ALL SELECT state, 'right' FROM z WHERE state NOT IN (SELECT state FROM a)",
        "key_files_cycle": "SELECT DISTINCT l_orderkey AS key FROM lineitem",
        "state_rank": f"{states}, low AS (SELECT DISTINCT state & 65535 AS state FROM st), a AS (SELECT range AS state, bit_count(range)::BIGINT AS population, {_parities_sql('range')} AS parity FROM range(65536)), r AS (SELECT *, row_number() OVER (PARTITION BY population, parity ORDER BY state) - 1 AS rank FROM a) SELECT state, population, parity, rank, state AS again FROM r WHERE state IN (SELECT state FROM low)",
        "state_rank_cycle": "WITH " + ", ".join(_state_sql(x, name=n) for n, x in BOARDS.items()) + " " + " UNION ALL ".join(f"SELECT '{n}' AS board, bit_count(state)::BIGINT AS population, count(*) AS states, count(*) AS kept FROM {n} GROUP BY 2" for n in BOARDS),
        "state_class_closure": _closure_sql(),
        "successors_in_sql": f"{children} SELECT state, jump::BIGINT AS jump, child FROM ch",
        "key_hash_mix64": _MIX_SQL.format(x="key::UBIGINT") + " SELECT key, (h & 4294967295)::BIGINT AS low32, (h >> 32)::BIGINT AS high32, xor(h & 4294967295, h >> 32)::BIGINT AS folded FROM m",
        "key_prefix_shard": _MIX_SQL.format(x="(key >> 7)::UBIGINT") + ", s AS (SELECT (xor(h, h >> 32) & 127)::BIGINT AS shard, count(*) AS n FROM m GROUP BY 1) SELECT range AS shard, coalesce(n, 0) AS n FROM range(128) LEFT JOIN s ON s.shard = range",
        "keys_distinct_sorted": "SELECT l_partkey AS key, row_number() OVER (ORDER BY l_partkey) - 1 AS ordinal FROM (SELECT DISTINCT l_partkey FROM lineitem)",
        "keys_union_dedup": "SELECT o_orderkey AS key FROM orders UNION SELECT l_orderkey FROM lineitem",
        "keys_except_both": "WITH a AS (SELECT l_partkey AS key, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey AS key, count(*) AS n FROM lineitem GROUP BY 1) SELECT coalesce(a.key, b.key) AS key, CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'left' ELSE 'right' END AS side, abs(coalesce(a.n, 0) - coalesce(b.n, 0)) AS copies FROM a FULL JOIN b ON a.key = b.key WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)",
        "keys_recent_antijoin": "SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority LIKE '1%')",
        "keys_ordinal_sample": f"{numbered} SELECT key, least({stride}, n - o)::BIGINT AS weight FROM r WHERE o % {stride} = 0",
        "keys_increasing_check": "SELECT count(*) AS violations FROM (SELECT o_custkey <= lag(o_custkey) OVER (ORDER BY o_orderkey) AS v FROM orders) WHERE v",
        "keys_gap_bytes": "SELECT key, gap, ceil(length(bin(gap)) / 7)::BIGINT AS bytes FROM (SELECT key, key - coalesce(lag(key) OVER (ORDER BY key), 0) AS gap FROM (SELECT DISTINCT l_partkey AS key FROM lineitem))",
        "quantile_bounds_unweighted": "WITH k AS (SELECT DISTINCT o_custkey AS key FROM orders), r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS o, count(*) OVER () AS n FROM k), q AS (SELECT range AS i, least(127, greatest(0, (SELECT count(*) FROM k) - 1)) AS b FROM range(127)) SELECT i AS bound_no, key AS bound FROM q JOIN r ON i < b AND o = ((i + 1) * n) // (b + 1)",
        "quantile_bounds_weighted": f"WITH w AS (SELECT o_custkey AS key, count(*)::DOUBLE AS w FROM orders GROUP BY 1), {cuts}",
        "shard_assign": f"WITH k AS (SELECT DISTINCT l_partkey AS key FROM lineitem) SELECT key, ({case})::BIGINT AS shard FROM k",
        "shard_balance": f"WITH k AS (SELECT l_partkey AS key FROM lineitem), {shards} SELECT max(n) AS largest, round(avg(n), 6) AS mean, round(max(n) / avg(n), 6) AS ratio, sum((n = 0)::BIGINT)::BIGINT AS empty FROM s",
        "batch_accounting": "SELECT o // 4096 AS batch, count(*) AS rows, min(key) AS first_key FROM (SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderkey) - 1 AS o FROM orders) GROUP BY 1",
        "summary_from_partitions": f"{numbered} SELECT (o * 256) // n AS bucket, min(key) AS first_key, count(*) AS weight FROM r GROUP BY 1",
        "dir_name_filter": f"SELECT try_cast(name AS BIGINT) AS round, count(*) AS n FROM (SELECT (o_custkey % 40)::VARCHAR || {_NAME_SQL} AS name FROM orders) WHERE regexp_full_match(name, '[1-9][0-9]*') GROUP BY 1",
        "throughput_summary": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, min(value) AS least, max(value) AS most FROM events GROUP BY 1",
        "unit_maths": "WITH a AS (SELECT avg(value) AS mean FROM events) SELECT event_type, count(*) AS states, round(count(*) * 8 / 1048576.0::DOUBLE / (sum(value) / 1000), 9) AS mib_per_s, 8.0::DOUBLE AS bytes_per_state, round((avg(value) - any_value(a.mean)) / any_value(a.mean) * 100, 9) AS percent FROM events, a GROUP BY 1",
        "pair_compare": "WITH s AS (SELECT l_linenumber, l_returnflag = 'R' AS r, avg(l_quantity) AS m, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1, 2) SELECT coalesce(a.l_linenumber, b.l_linenumber)::BIGINT AS line, round((b.m - a.m) / a.m * 100, 6) AS percent, (greatest(a.lo, b.lo) <= least(a.hi, b.hi))::BIGINT AS overlap FROM (SELECT * FROM s WHERE r) a FULL JOIN (SELECT * FROM s WHERE NOT r) b ON a.l_linenumber = b.l_linenumber",
        "stream_user_totals": "SELECT user_id, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1",
    }
    return queries, sql


QUERIES, SQL = _registered()
