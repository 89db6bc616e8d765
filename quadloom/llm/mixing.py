"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents fall into cells (source, language, topic). Token weights of the cells
are raked in turn to the target of each source, language and topic, never
above what the cell has; the fitted weight over the cell's tokens is the
probability with which each of its documents is drawn. The draw of a document
is a hash of its doc_id, so a run can be repeated and a larger budget only adds.

A category's target is its share of the budget, or all its tokens where that is less; what
is missing is then spread over the other categories by their shares, so the
targets of each kind add up to the budget. `report` states what the fit leaves over for each
category, and `plan` warns if that is more than `TOLERANCE` of the budget.

Tokens are words plus one. The topic is a column that the caller names, or,
as these tables have none, the form of the text: `brief` (under 50 words),
`article`, or `long` (1000 words and more).

Up to `MAX_CELLS` cells go to one task, where the raking runs as window sums without further
shuffles, and are broadcast to the documents. More are raked by aggregates and
joins, with the cells written after each round, and joined: the same sums and weights.

Cases: a null source, language, topic or text is the category `(none)`, or no
words; a null doc_id draws as the text `null`; repeated rows are drawn alike; a
category with a target share of 0 is never drawn;
names of extra columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadloom.llm.scratch import Scratch

#: Target shares: for each category (others keep their tokens' share), or None for shares that follow the square root of the tokens. They are scaled to the categories that there are.
TARGETS: dict[str, dict[str, float] | None] = {"source": None, "lang": {"en": 0.5, "fr": 0.2, "de": 0.15, "es": 0.15}, "topic": {"brief": 0.05, "article": 0.65, "long": 0.3}}
#: Share of all tokens to draw, rounds of raking, and what the draw's hash starts with.
BUDGET, ROUNDS, SEED = 0.6, 15, "mix"
MAX_CELLS = 200_000
#: The part of the budget by which a category may miss its target before `plan` warns.
TOLERANCE = 0.01
#: Words from which a text is an article, and long.
BRIEF, LONG = 50, 1000
_NONE = "(none)"


def _words() -> Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _form(n_words: Column) -> Column:
    return F.when(n_words < BRIEF, "brief").when(n_words < LONG, "article").otherwise("long")


def _draw(seed: str) -> Column:
    """A number in [0, 1) from the doc_id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _keyed(docs: DataFrame, topic: str | None) -> DataFrame:
    words = _words()
    held = docs.select(
        F.col("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit(_NONE)).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit(_NONE)).alias("lang"),
        *([F.coalesce(F.col(topic).cast("string"), F.lit(_NONE)).alias("topic")] if topic else []),
        words.alias("n_words"),
    )
    return (held if topic else held.withColumn("topic", _form(F.col("n_words")))).withColumn("n_tokens", F.col("n_words") + 1).drop("n_words")


def _goals(cells: DataFrame, dim: str, spec: dict[str, float] | None, total: float, budget: float, work: Scratch) -> DataFrame:
    """(dim, goal in tokens) of each category."""
    mass = cells.groupBy(dim).agg(F.sum("tokens").alias("mass"))
    if spec is None:
        share = F.sqrt("mass")
    else:
        known = F.create_map(*[F.lit(x) for k, v in spec.items() for x in (k, float(v))]) if spec else None
        share = F.coalesce(known[F.col(dim)], F.col("mass") / total) if spec else F.col("mass") / total
    held = work.write(f"goals-{dim}", mass.withColumn("share", share))
    level, count = 0.0, -1  # tokens for a share of 1; it rises as categories that have too few give all they have
    while True:
        full = (F.col("mass") <= level * F.col("share")) & (F.col("share") > 0)
        taken, left, n = held.agg(F.sum(F.when(full, F.col("mass")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("share"))), F.count_if(full)).first()
        if not left:
            return held.select(dim, F.when(F.col("share") > 0, F.col("mass")).otherwise(0.0).alias(f"goal_{dim}"))
        if n == count:
            return held.select(dim, F.least("mass", level * F.col("share")).alias(f"goal_{dim}"))
        level, count = max(0.0, total * budget - taken) / left, n


def _raked(cells: DataFrame, dim: str, now: Column) -> DataFrame:
    """Cells with their weight scaled to the goal of their category, whose weight is `now`."""
    scaled = F.least("tokens", F.col("weight") * F.col(f"goal_{dim}") / F.nullif(now, F.lit(0.0)))
    return cells.withColumn("weight", F.coalesce(scaled, F.lit(0.0)))


def fit(cells: DataFrame, targets: dict[str, dict[str, float] | None] = TARGETS, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """Cells (source, lang, topic, tokens) with the fitted `weight` in tokens, the `probability` of their documents and the goals of their categories."""
    work = Scratch(cells.sparkSession, "raking")
    held = work.write("cells", cells.withColumn("tokens", F.col("tokens").cast("double")))
    n, total = held.agg(F.count("*"), F.sum("tokens")).first()
    few = n <= MAX_CELLS
    one = held
    for dim, spec in targets.items():
        goals = _goals(held, dim, spec, total or 1.0, budget, work)
        one = one.join(F.broadcast(goals) if few else goals, dim)
    one = one.withColumn("weight", F.col("tokens") * budget)
    if few:
        one = one.repartition(1)
    for k in range(rounds):
        for dim in targets:
            if few:
                one = _raked(one.withColumn("now", F.sum("weight").over(Window.partitionBy(dim))), dim, F.col("now"))
            else:
                one = _raked(one.join(one.groupBy(dim).agg(F.sum("weight").alias("now")), dim), dim, F.col("now")).drop("now")
        if not few:
            one = work.write(f"round-{k}", one)
            work.drop(f"round-{k - 1}")
    return one.select("source", "lang", "topic", "tokens", "weight", (F.col("weight") / F.col("tokens")).alias("probability"), *(f"goal_{dim}" for dim in targets))


def report(fitted: DataFrame, dims: list[str] | None = None) -> DataFrame:
    """dim, category, goal, weight and residual (their difference, as a part of all goals of the kind) of each category of fitted cells."""
    out = None
    for dim in dims or list(TARGETS):
        part = fitted.groupBy(F.lit(dim).alias("dim"), F.col(dim).alias("category")).agg(F.max(f"goal_{dim}").alias("goal"), F.sum("weight").alias("weight"))
        out = part if out is None else out.unionByName(part)
    whole = F.sum("goal").over(Window.partitionBy("dim"))
    return out.withColumn("residual", F.coalesce((F.col("weight") - F.col("goal")) / F.nullif(whole, F.lit(0.0)), F.lit(0.0)))


def plan(docs: DataFrame, topic: str | None = None, targets: dict | None = None, budget: float = BUDGET) -> tuple[DataFrame, bool]:
    """The fitted cells of a corpus, written to the shared folder, and whether they are few enough to be broadcast."""
    targets = targets or TARGETS
    cells = _keyed(docs, topic).groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"))
    work = Scratch(docs.sparkSession, "mixing")
    fitted = work.write("fitted", fit(cells, targets, budget))
    n, worst = fitted.count(), report(fitted, list(targets)).agg(F.max(F.abs("residual"))).first()[0] or 0.0
    if worst > TOLERANCE:
        warnings.warn(f"a category misses its target by {worst:.2%} of the budget after {ROUNDS} rounds: the cells have no tokens for these targets", stacklevel=2)
    return fitted, n <= MAX_CELLS


def mix(docs: DataFrame, topic: str | None = None, targets: dict | None = None, budget: float = BUDGET, seed: str = SEED) -> DataFrame:
    """doc_id, its cell, n_tokens, probability and whether it is selected, of every document."""
    fitted, few = plan(docs, topic, targets, budget)
    fitted = fitted.select("source", "lang", "topic", "probability")
    return (
        _keyed(docs, topic)
        .join(F.broadcast(fitted) if few else fitted, ["source", "lang", "topic"])  # at most MAX_CELLS rows are broadcast
        .select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), (_draw(seed) < F.col("probability")).alias("selected"))
    )


def query(docs: DataFrame) -> DataFrame:
    return mix(docs)


def keep(docs: DataFrame, topic: str | None = None, targets: dict | None = None, budget: float = BUDGET, seed: str = SEED) -> DataFrame:
    """The selected rows with all their columns."""
    fitted, few = plan(docs, topic, targets, budget)
    cell = F.struct(
        F.coalesce(F.col("source").cast("string"), F.lit(_NONE)),
        F.coalesce(F.col("lang").cast("string"), F.lit(_NONE)),
        F.coalesce(F.col(topic).cast("string"), F.lit(_NONE)) if topic else _form(_words()),
    )
    key = "_cell_of_mixing_"
    of = fitted.select(F.struct("source", "lang", "topic").cast("struct<col1:string,col2:string,col3:string>").alias(key), F.col("probability").alias(f"{key}p"))
    kept = docs.withColumn(key, cell.cast("struct<col1:string,col2:string,col3:string>")).withColumn(f"{key}u", _draw(seed)).join(F.broadcast(of) if few else of, key)
    return kept.where(F.col(f"{key}u") < F.col(f"{key}p")).select(docs.columns)


def sql() -> str:
    """The same rows in DuckDB, the raking unrolled and the levels of the goals in closed form."""
    steps, last = [], "start"
    for r in range(ROUNDS):
        for dim in TARGETS:
            name = f"r{r}_{dim}"
            steps.append(f"{name} AS MATERIALIZED (SELECT * REPLACE (least(tokens, weight * goal_{dim} / now) AS weight) FROM (SELECT * EXCLUDE (now), sum(weight) OVER (PARTITION BY {dim}) AS now FROM {last}))")
            last = name
    goals = []
    for dim, spec in TARGETS.items():
        share = "sqrt(sum(tokens))" if spec is None else f"CASE {dim} {' '.join(f'WHEN {k!r} THEN {v!r}::DOUBLE' for k, v in spec.items())} ELSE sum(tokens) / any_value(total) END"
        goals.append(f"""share_{dim} AS (SELECT {dim}, any_value(total) AS total, sum(tokens) AS mass, {share} AS share FROM cells, total GROUP BY {dim}),
goals_{dim} AS MATERIALIZED (SELECT {dim}, least(mass, share * max((total * {BUDGET} - before) / rest) OVER ()) AS goal_{dim} FROM (SELECT *,
  coalesce(sum(mass) OVER (ORDER BY mass / share, {dim} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(share) OVER (ORDER BY mass / share, {dim} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM share_{dim}))""")
    return f"""
WITH k AS (SELECT doc_id, coalesce(source, '{_NONE}') AS source, coalesce(lang, '{_NONE}') AS lang, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n FROM documents),
d AS (SELECT doc_id, source, lang, CASE WHEN n < {BRIEF} THEN 'brief' WHEN n < {LONG} THEN 'article' ELSE 'long' END AS topic, CAST(n + 1 AS BIGINT) AS n_tokens FROM k),
cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL),
total AS (SELECT sum(tokens) AS total FROM cells),
{", ".join(goals)},
start AS MATERIALIZED (SELECT *, tokens * {BUDGET} AS weight, 0::DOUBLE AS now FROM cells {" ".join(f"JOIN goals_{dim} USING ({dim})" for dim in TARGETS)}),
{", ".join(steps)}
SELECT doc_id, source, lang, topic, n_tokens, round(weight / tokens, 6) AS probability,
  CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / {float(1 << 52)!r}::DOUBLE < weight / tokens AS selected
FROM d JOIN {last} USING (source, lang, topic)
"""
