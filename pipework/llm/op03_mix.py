"""Mixing sources to target weights by entropy balancing.

Document rates r = min(cap, prior * exp(lambda of its source)) minimise the
token-weighted relative entropy to the prior under one token constraint per
source. Distributed Newton steps solve the convex dual: every step is one
grouped sum over the documents and one update of the table of multipliers.
Rates are then rounded into whole copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import columns, keep, maybe_broadcast, numbered, small, unit_hash

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Documents per ordered bucket of a source when copies are dealt out.
BUCKET_ROWS = 50_000


def _measures(text, source) -> list:
    """size (words; null has none), th (hash of the text), sk (source, never null: "s" + source, or "t" for null, which sorts last)."""
    return [F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(text).alias("th"), F.coalesce(F.concat(F.lit("s"), source), F.lit("t")).alias("sk")]


def measured(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """doc_id, size, th and sk (see _measures), rid."""
    d = columns(docs, doc_id=id_col, text=text_col, source=source_col)
    d = d.select("doc_id", *_measures(F.col("text"), F.col("source")))
    return keep(d.withColumn("rid", F.monotonically_increasing_id()), "measured")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sk, source_size, target. Sources in code point order get the weights in
    turn; what a source's cap (cap * its size) can't hold is shared again by weight."""
    totals = sizes.groupBy("sk").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ordered, chunks = numbered(totals, ["sk"], "sources")
    first, at = [], 0
    for c, n in chunks:
        first.append((c, at))
        at += n
    starts = sizes.sparkSession.createDataFrame(first, "chunk long, first long")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("idx") + F.col("first"), F.lit(len(weights))) + 1).cast("int"))
    t = keep(ordered.join(F.broadcast(starts), "chunk").select("sk", "source_size", "n_docs", pick.alias("w")), "weights")
    total = share * (t.agg(F.sum("source_size")).first()[0] or 0)
    theta, room = 0.0, F.col("source_size") * cap
    fixed, capped = None, -1
    while True:  # the set of capped sources only grows
        full = F.lit(False) if fixed is None else room <= F.col("w") * fixed
        held, free, n = t.agg(F.coalesce(F.sum(F.when(full, room)), F.lit(0.0)),
                              F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0)), F.sum(full.cast("int"))).first()
        if not free or n == capped:
            break
        capped, theta = n, (total - held) / free
        fixed = theta
    if not free:
        return t.select("sk", "source_size", "n_docs", room.alias("target"))
    return t.select("sk", "source_size", "n_docs", F.least(room, F.col("w") * theta).alias("target"))


def balance(sizes: DataFrame, goal: DataFrame, prior=None, cap: float = 2.0, steps: int = 40) -> DataFrame:
    """sk and lam, the multipliers at which sum(size * min(cap, prior * exp(lam))) meets target."""
    prior = F.lit(1.0) if prior is None else prior
    lam = keep(goal.withColumn("lam", F.lit(0.0)), "lam")
    for _ in range(steps):
        rate = F.least(F.lit(cap), prior * F.exp("lam"))
        free = prior * F.exp("lam") < cap
        got = (sizes.join(maybe_broadcast(lam.select("sk", "lam")), "sk").groupBy("sk")
               .agg(F.sum(F.col("size") * rate).alias("g"), F.sum(F.when(free, F.col("size") * rate).otherwise(0.0)).alias("dg")))
        # Newton's step on log g, whose slope is dg / g
        step = F.when((F.col("target") > 0) & (F.col("dg") > 0), F.greatest(F.lit(-4.0), F.least(
            F.lit(4.0), F.log(F.col("target") / F.col("g")) * F.col("g") / F.col("dg")))).otherwise(0.0)
        far = F.when((F.col("target") > 0) & (F.col("dg") > 0), F.abs(F.col("g") / F.col("target") - 1)).otherwise(0.0)
        nxt = keep(lam.join(got, "sk").select("sk", "source_size", "n_docs", "target", far.alias("far"),
                                              (F.col("lam") + step).alias("lam")), "lam")
        lam = nxt.drop("far")
        if (nxt.agg(F.max("far")).first()[0] or 0.0) < 1e-9:
            break
    return lam


def bucketed(d: DataFrame) -> DataFrame:
    """d with b, buckets in order of p = hash / part within (sk, cls), of about
    BUCKET_ROWS rows: the share of rows up to p follows from the parts, of which
    those within a factor of two count as one."""
    parts = d.groupBy("sk", "cls", F.floor(F.log2("part")).alias("kind")).agg(F.count("*").alias("n"), F.avg("part").alias("f"))
    parts = keep(parts.groupBy("sk", "cls").agg(F.collect_list(F.struct("n", "f")).alias("parts"), F.sum("n").alias("rows")), "parts")
    below = F.aggregate("parts", F.lit(0.0), lambda x, k: x + k["n"] * F.least(F.lit(1.0), k["f"] * F.col("p")))
    n = F.ceil(F.col("rows") / BUCKET_ROWS)
    b = F.least(n - 1, F.floor(below / F.col("rows") * n)).alias("b")
    return d.join(maybe_broadcast(parts), ["sk", "cls"]).select(*[d[c] for c in d.columns], b)


def _rated(d: DataFrame, prior=None, cap: float = 2.0) -> DataFrame:
    """d (doc_id, size, th, target, lam, others) with base, the whole part of the rate; part, the
    fraction; may, whether there is one; p, the place in the order of dealing; and cls, the size class."""
    prior = F.lit(1.0) if prior is None else prior
    rate = F.when(F.col("target") > 0, F.least(F.lit(cap), prior * F.exp("lam"))).otherwise(0.0)
    d = d.withColumn("rate", rate).withColumn("base", F.floor(F.col("rate") + 1e-9)).withColumn("may", F.col("rate") - F.col("base") > 1e-9)
    d = d.withColumn("part", F.greatest(F.col("rate") - F.col("base"), F.lit(1e-12)))
    return d.withColumn("p", unit_hash("doc_id", "size", "th", F.lit("mix")) / F.col("part")).withColumn("cls", F.length(F.bin("size")) - 1)


def copies(sizes: DataFrame, lam: DataFrame, prior=None, cap: float = 2.0, fills: int = 5) -> DataFrame:
    """sizes with copies; also base, may, p and cls (see _rated) and first, 1 if the row was dealt
    a copy of its fraction before the last step, null if it was not dealt by class. Whole parts of the rates are copies. The fractions are
    dealt by size class (powers of two), largest first: each class gets its
    share of the source's remaining words and what larger classes left over, in
    order of hash / fraction, and one document more if the smaller classes
    can't make up for it. Then single documents that bring the source nearer to
    its target get one copy more or fewer."""
    d = _rated(sizes.join(maybe_broadcast(lam), "sk"), prior, cap)
    d = keep(d.select("doc_id", "sk", "size", "th", "rid", "source_size", "target", "base", "p", "part", "cls", "may"), "dealt")
    deal = F.col("may") & (F.col("size") > 0)
    extra = d.groupBy("sk").agg((F.max("target") - F.sum(F.col("base") * F.col("size"))).alias("extra"))
    dealt = bucketed(d.where(deal))
    per = keep(dealt.groupBy("sk", "cls", "b").agg(F.sum("size").alias("s"), F.sum(F.col("size") * F.col("part")).alias("q")), "buckets")
    before = per.select("sk", "cls", "b", F.coalesce(F.sum("s").over(
        W.partitionBy("sk", "cls").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    smaller = W.partitionBy("sk").orderBy("cls").rowsBetween(W.unboundedPreceding, -1)
    shares = per.groupBy("sk", "cls").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).join(extra, "sk").select(
        "sk", "cls", "extra", F.coalesce(F.sum("s").over(smaller), F.lit(0)).alias("room"),
        (F.coalesce(F.sum("q").over(smaller), F.lit(0.0)) / F.sum("q").over(W.partitionBy("sk")) * F.col("extra")).alias("due"))
    shares = keep(shares, "shares")
    w = W.partitionBy("sk", "cls", "b").orderBy("p", "doc_id", "size", "th", "rid")
    run = dealt.join(maybe_broadcast(before), ["sk", "cls", "b"]).withColumn("used", F.col("before") + F.sum("size").over(w))
    run = keep(run.select("doc_id", "sk", "size", "rid", "source_size", "target", "base", "p", "cls", "used"), "prefix")

    few = small(shares, 100_000)
    near = F.broadcast if few else (lambda x: x)
    state = shares.groupBy("sk").agg(F.max("extra").alias("left")).withColumn("cuts", F.expr("CAST(array() AS array<struct<cls: int, upto: bigint>>)"))
    state = keep(state.coalesce(1) if few else state, "left")
    miss = lambda rest: F.greatest(rest - F.col("room"), -rest, F.lit(0.0))  # noqa: E731  what the smaller classes can't mend
    for c in sorted((r.cls for r in shares.select("cls").distinct().collect()), reverse=True):
        now = state.join(near(shares.where(F.col("cls") == c)), "sk").select("sk", "left", "room", F.round(F.col("left") - F.col("due"), 3).alias("top"))
        got = run.where(F.col("cls") == c).join(near(now), "sk").groupBy("sk").agg(
            F.max("left").alias("l"), F.max("room").alias("room"),
            F.coalesce(F.max(F.when(F.col("used") <= F.col("top"), F.col("used"))), F.lit(0)).alias("fit"),
            F.min(F.when(F.col("used") > F.col("top"), F.col("used"))).alias("next"))
        upto = F.when(F.col("next").isNotNull() & (miss(F.col("l") - F.col("next")) < miss(F.col("l") - F.col("fit"))), F.col("next")).otherwise(F.col("fit"))
        cut = F.array(F.struct(F.lit(c).alias("cls"), F.col("upto")))
        state = keep(state.join(near(got.select("sk", upto.alias("upto"))), "sk", "left").select(
            "sk", (F.col("left") - F.coalesce("upto", F.lit(0))).alias("left"),
            F.when(F.col("upto").isNull(), F.col("cuts")).otherwise(F.concat("cuts", cut)).alias("cuts")), "left")
    cuts = state.join(extra, "sk").select("sk", "extra", F.explode("cuts").alias("c")).select("sk", "extra", "c.cls", "c.upto")
    cuts = keep(cuts, "cuts")
    one = keep(run.join(near(cuts), ["sk", "cls"]).withColumn("more", (F.col("used") <= F.col("upto")).cast("int")).withColumn("first", F.col("more")), "dealt-more")
    for _ in range(fills):  # one more or one fewer copy of the document that brings the source nearest to its target
        gap = one.groupBy("sk").agg((F.max("extra") - F.sum(F.col("more") * F.col("size"))).alias("gap"))
        after = F.abs(F.col("gap") - F.when(F.col("more") == 0, F.col("size")).otherwise(-F.col("size")))
        fit = one.join(maybe_broadcast(gap), "sk").withColumn("after", after)
        best = fit.where(F.col("after") < F.abs("gap")).groupBy("sk").agg(F.min(F.struct("after", "p", "rid"))["rid"].alias("rid"))
        best = keep(best.withColumn("turn", F.lit(1)), "turn")
        one = one.join(maybe_broadcast(best), ["sk", "rid"], "left").withColumn(
            "more", F.abs(F.col("more") - F.coalesce("turn", F.lit(0)))).drop("turn")
    # rows without a fraction or without words are not dealt; the latter go by their own hash
    rest = d.where(~deal).withColumn("more", (F.col("may") & (F.col("p") <= 1)).cast("int")).withColumn("first", F.lit(None).cast("int"))
    out = ["doc_id", "sk", "size", "rid", "source_size", "target", "base", "may", "p", "cls", "first", "more"]
    return one.withColumn("may", F.lit(True)).select(*out).unionByName(rest.select(*out)).withColumn("copies", (F.col("base") + F.col("more")).cast("int"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS,
        share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, size (words), source_size, target (of its source), copies, taken
    (copies * size); one row per row of ``docs``.

    A null source is a source of its own, ordered last. Null and empty texts
    have no words and take none; so does a source without words. Repeated rows
    and rows that share an id are documents of their own. Equal runs agree:
    only doc_id, size, text and source decide; rows equal in all of them are
    interchangeable. Other columns are not read; an empty table gives no rows."""
    sizes = measured(docs, id_col, text_col, source_col)
    goal = targets(sizes, weights, share, cap)
    d = copies(sizes, balance(sizes, goal, cap=cap), cap=cap)
    return d.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "copies",
                    (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def _expected(cuts) -> F.Column:
    """Copies of a row by its own place alone: whole part, and one more up to the cut of its class."""
    upto = F.when(F.col("size") > 0, F.element_at(cuts, F.col("cls"))).otherwise(F.lit(1.0))
    return (F.col("base") + (F.col("may") & F.coalesce(F.col("p") <= upto, F.lit(False))).cast("int")).cast("int")


def mixed(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS,
          share: float = 1.5, cap: float = 2.0, exceptions: int = 500_000) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as ``mix`` has copies of its id;
    rows that share an id get the most copies of them.

    Texts are not shuffled. The dealing leaves a cut in every size class of a source, and
    most rows tell their copies from it; ids for which ``mix`` decided otherwise (last steps,
    ties at a cut, rows that share an id) are joined, by broadcast up to ``exceptions`` ids."""
    sizes = measured(docs, id_col, text_col, source_col)
    lam = balance(sizes, targets(sizes, weights, share, cap), cap=cap)
    done = keep(copies(sizes, lam, cap=cap).select("doc_id", "sk", "size", "base", "may", "p", "cls", "first", "copies"), "copies")
    cuts = done.where("first = 1").groupBy("sk", "cls").agg(F.max("p").alias("upto"))
    cuts = cuts.groupBy("sk").agg(F.map_from_entries(F.collect_list(F.struct("cls", "upto"))).alias("cuts"))  # a class for each power of two
    rule = maybe_broadcast(keep(lam.join(cuts, "sk", "left").select("sk", "target", "lam", "cuts"), "rule"))
    odd = done.join(rule.select("sk", "cuts"), "sk").groupBy("doc_id").agg(
        F.max("copies").alias("n"), F.min(_expected(F.col("cuts"))).alias("least"), F.max(_expected(F.col("cuts"))).alias("most"))
    odd = keep(odd.where("least <> n OR most <> n").select(F.col("doc_id").alias("__id"), F.col("n").alias("__n")), "odd")
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *_measures(F.col(f"`{text_col}`"), F.col(f"`{source_col}`")), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    d = _rated(d.join(rule, "sk"), cap=cap).select("doc_id", "row", _expected(F.col("cuts")).alias("expected"))
    d = d.join(maybe_broadcast(odd, exceptions), d["doc_id"].eqNullSafe(odd["__id"]), "left").withColumn("n", F.coalesce("__n", "expected"))
    return d.where("n > 0").select("row", F.explode(F.sequence(F.lit(1), "n"))).select("row.*")
