"""Order flow: decayed signed trades on a regular grid, the engine that trades on them, and metaorders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.scalars import correlation
from marlstone.functions.stored import stored
from marlstone.operators.decay import decayed_flow, decayed_sums, power_law_mixture
from marlstone.operators.models import metaorders
from marlstone.operators.series import as_of


def concave(sign: Column, quantity: Column, power: float = 0.5) -> Column:
    """sign * quantity ** power: large trades count less than in proportion."""
    return F.signum(sign) * F.pow(quantity, F.lit(power))


def grid_of(df: DataFrame, keys, time: str, step: float) -> DataFrame:
    """keys and grid: the multiples of `step` from a key's first time, rounded down, to its last, rounded up. Times are numbers."""
    ends = df.groupBy(*keys).agg(F.floor(F.min(time) / step).cast("long").alias("a"), F.ceil(F.max(time) / step).cast("long").alias("b"))
    return ends.select(*keys, F.explode(F.sequence("a", "b")).alias("n")).select(*keys, (F.col("n") * step).alias("grid"))


def flow_on_grid(trades: DataFrame, time: str, amount: str, keys, row_id: str, step: float, taus: Sequence[float], weights: Sequence[float]) -> DataFrame:
    """keys, grid, flow: the decayed sum of the amounts up to each grid time, that time's trades included. Grid times join the trades as rows of no amount."""
    marks = grid_of(trades, keys, time, step).select(*keys, F.col("grid").alias("at"), F.lit(0.0).alias("q"), F.struct(F.lit(1).alias("late"), F.lit(None).cast(trades.schema[row_id].dataType).alias("id")).alias("row"))
    rows = trades.select(*keys, F.col(time).cast("double").alias("at"), F.col(amount).alias("q"), F.struct(F.lit(0).alias("late"), F.col(row_id).alias("id")).alias("row"))
    marks = marks.withColumn("row", F.struct(F.lit(1).alias("late"), F.lit(None).cast(trades.schema[row_id].dataType).alias("id"), F.col("at")))
    both = rows.withColumn("row", F.struct("row.late", "row.id", F.col("at"))).unionByName(marks)
    flow = decayed_flow(both, "at", "q", keys, "row", taus, weights)
    return flow.filter("row.late = 1").select(*keys, F.col("row.at").alias("grid"), "flow")


def detect_metaorders(trades: DataFrame, time: str, quantity: str, sign: str, keys, row_id: str, step: float = 0.25, power: float = 0.5, **options) -> DataFrame:
    """Metaorders from trades alone: the score is the decayed flow of concave signed quantities on a grid, under a mixture for 1 / sqrt(t), and its stretches are those of models.metaorders; n_child and vol count the trades of the stretch's sign in it. Options: those of models.metaorders."""
    from marlstone.operators.joins import in_intervals

    taus, weights = power_law_mixture(0.05, 10, 0.1, 600.0)
    rows = trades.withColumn("concave_quantity", concave(F.col(sign), F.col(quantity), power))
    score = flow_on_grid(rows, time, "concave_quantity", keys, row_id, step, taus, weights).withColumn("way", F.signum("flow").cast("int"))
    least = options.pop("least", 5)
    spans = metaorders(score, "grid", "flow", "way", keys, ["grid"], least=1, **options).drop("n_child")
    own = trades.select(*keys, F.col(time).cast("double").alias("at"), F.col(quantity).alias("q"), F.signum(sign).cast("int").alias("own_sign"))
    inside = in_intervals(own, spans, keys, "at", "t0", "t1", 60.0).filter("own_sign = sign")
    return inside.groupBy(*keys, "t0", "t1", "sign").agg(F.count("*").alias("n_child"), F.sum("q").alias("vol")).filter(F.col("n_child") >= least)


def flow_engine(
    trades: DataFrame, quotes: DataFrame, depth: DataFrame, keys, time: str, row_id: str, *, step: float = 1.0, horizon: float = 60.0, power: float = 0.5, eps: float = 0.05, mixtures: int = 10, shortest: float = 0.1,
    longest: float = 600.0, alpha: float = 0.05, ridge: float = 1e-4, tick: float = 0.01, widest: float = 2.0, least_depth: float = 200.0, fee_bps: float = 1.0, slip_ticks: float = 0.2,
) -> DataFrame:
    """Per key: corr_pred_realized, beta_hat, n_trades, pnl_price_units, avg_trade_notional, obs_count, sharpe_like_of_preds.

    trades (time, row_id, price, qty, aggressor: 1, -1, or 0 or null to be told by the last mid, else by the tick), quotes (time,
    row_id, bid, ask), depth (time, row_id, bid_sz, ask_sz); times are seconds as numbers. On a grid that all three cover,
    the decayed flow of concave signed quantities is the signal x, the log return of mid over `horizon` the outcome y.
    A decayed fit of y on x, the own row included, gives the forecast. A trade is made where spread and depth allow and the
    forecast is beyond half a spread and the slippage; its result bears spread, fee and slippage twice.
    """
    ends = None
    for df in (trades, quotes, depth):
        own = df.groupBy(*keys).agg(F.min(time).alias("a"), F.max(time).alias("b"))
        ends = own if ends is None else ends.unionByName(own)
    ends = ends.groupBy(*keys).agg(F.ceil(F.max("a")).cast("double").alias("a"), F.floor(F.min("b")).cast("double").alias("b")).filter("a <= b")
    grid = ends.select(*keys, "a", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("b") - F.col("a")) / step).cast("long"))).alias("n"))
    grid = grid.select(*keys, (F.col("a") + F.col("n") * step).alias(time), F.col("n").alias(row_id))

    mids = quotes.withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    # Several steps read the grid, the signed trades and the signal: each is worked out once.
    at_grid = stored(as_of(as_of(grid, mids, keys, time, row_id, ["bid", "ask", "mid"]), depth, keys, time, row_id, ["bid_sz", "ask_sz"]), "flow-grid")
    # Signs: by the mid of the last grid time, the first one's for trades before it, and by the tick on it.
    firsts = at_grid.groupBy(*keys).agg(F.min_by("mid", time).alias("first_mid"), F.min(time).alias("begin"))
    w_trade = Window.partitionBy(*keys).orderBy(time, row_id)
    signed = as_of(trades, at_grid.select(*keys, time, row_id, "mid"), keys, time, row_id, ["mid"]).join(firsts, list(keys)).withColumn("mid", F.coalesce("mid", "first_mid"))
    rule = F.signum(F.col("price") - F.col("mid"))
    tick_rule = F.signum(F.col("price") - F.lag("price").over(w_trade))
    sign = F.coalesce(F.nullif(F.col("aggressor").cast("double"), F.lit(0.0)), F.nullif(rule, F.lit(0.0)), F.nullif(tick_rule, F.lit(0.0)), F.lit(1.0))
    signed = stored(signed.withColumn("q", concave(sign, F.col("qty"), power)).select(*keys, time, row_id, "q"), "flow-trades")

    # The states are not decayed between a grid time and the trade before it: the signal is that trade's.
    taus, weights = power_law_mixture(eps, mixtures, shortest, longest)
    flow = decayed_flow(signed, time, "q", keys, row_id, taus, weights)
    signal = as_of(at_grid, signed.select(*keys, time, row_id).join(flow, [*keys, row_id]), keys, time, row_id, ["flow"]).withColumn("x", F.coalesce("flow", F.lit(0.0)))
    w = Window.partitionBy(*keys).orderBy(time)
    ahead = F.lead("mid", round(horizon / step)).over(w)
    signal = signal.withColumn("y", F.when((ahead > 0) & (F.col("mid") > 0), F.ln(ahead / F.col("mid"))))
    start = 1e-6  # what the mean of squares begins with
    signal = signal.withColumns({"seen": F.count("y").over(w.rowsBetween(Window.unboundedPreceding, 0)), "xx": F.when(F.col("y").isNotNull(), F.col("x") * F.col("x")), "xy": F.col("x") * F.col("y")})
    signal = stored(signal, "flow-signal")
    # Decayed means that begin with 0, not with the first value: no row looks back over a frame of rows. Rows without y have no age, so they keep the last one's.
    rows = decayed_sums(signal, {"mxx": "xx", "mxy": "xy"}, keys, [time], 1 - alpha, F.col("seen"))
    rows = rows.withColumn("b", alpha * F.col("mxy") / (alpha * F.col("mxx") + F.pow(F.lit(1 - alpha), F.col("seen")) * start + ridge))
    rows = rows.withColumns({"guess": F.col("b") * F.col("x"), "price_now": F.greatest(F.col("mid"), F.lit(1e-6)), "half": (F.col("ask") - F.col("bid")) / tick / 2})
    open_now = (2 * F.col("half") <= widest) & (F.col("bid_sz") + F.col("ask_sz") >= least_depth) & F.col("y").isNotNull() & (F.abs("guess") > (F.col("half") + slip_ticks) * tick / F.col("price_now"))
    rows = rows.withColumn("traded", F.coalesce(open_now, F.lit(False)))
    cost = (F.col("half") + slip_ticks) * tick + fee_bps * 1e-4 * F.col("price_now")
    result = F.when(F.col("traded"), F.when(F.col("guess") > 0, 1.0).otherwise(-1.0) * F.col("price_now") * F.col("y") - 2 * cost)
    done = F.when(F.col("y").isNotNull(), F.col("guess"))
    n = F.count(done)
    return rows.groupBy(*keys).agg(
        F.when(n > 10, correlation(done, F.col("y"))).alias("corr_pred_realized"), F.max_by("b", time).alias("beta_hat"), F.count_if("traded").alias("n_trades"), F.coalesce(F.sum(result), F.lit(0.0)).alias("pnl_price_units"),
        (F.coalesce(F.sum(F.when(F.col("traded"), F.col("price_now"))), F.lit(0.0)) / F.greatest(F.count_if("traded"), F.lit(1))).alias("avg_trade_notional"), n.alias("obs_count"),
        F.when(n > 1, F.avg(done) / (F.stddev_pop(done) + 1e-9)).alias("sharpe_like_of_preds"),
    )


def mapped_metaorders(trades: DataFrame, time: str, quantity: str, sign: str, keys, order, row_id: str, *, traders: int = 20, same: float = 0.05, sticky: float = 0.85, seed: int = 17) -> DataFrame:
    """Synthetic metaorders: t0, t1, sign, n_child, vol per key of runs of more than one trade of one synthetic trader and sign.

    A trade keeps the trader before it with probability `same`, else draws one of `traders`; it keeps its trader's last sign with
    probability `sticky`, else brings its own, which then is the last one. The draws are hashes of row_id and seed, so
    reruns agree. The last trader drawn and the last sign brought are windows; nothing is folded row by row.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = lambda window: window.rowsBetween(Window.unboundedPreceding, 0)
    draw = lambda n: F.pmod(F.xxhash64(F.col(row_id), F.lit(seed), F.lit(n)), F.lit(1 << 30)) / float(1 << 30)
    first = F.row_number().over(w) == 1
    rows = trades.withColumn("drawn", F.when(first | (draw(0) >= same), F.floor(draw(1) * traders)))
    rows = rows.withColumn("trader", F.last("drawn", ignorenulls=True).over(upto(w)))
    w_own = Window.partitionBy(*keys, "trader").orderBy(*order)
    brought = F.when((F.row_number().over(w_own) == 1) | (draw(2) >= sticky), F.signum(sign).cast("int"))
    rows = rows.withColumn("brought", brought).withColumn("way", F.last("brought", ignorenulls=True).over(upto(w_own)))
    new = F.coalesce((F.lag("trader").over(w) != F.col("trader")) | (F.lag("way").over(w) != F.col("way")), F.lit(True)).cast("int")
    rows = rows.withColumn("new", new).withColumn("run", F.sum("new").over(upto(w)))
    runs = rows.groupBy(*keys, "run").agg(F.min(time).alias("t0"), F.max(time).alias("t1"), F.first("way").alias("sign"), F.count("*").alias("n_child"), F.sum(quantity).alias("vol"))
    return runs.filter("n_child > 1").drop("run")
