"""Mixing sources to target weights by iterative proportional fitting.

Tokens (words) are counted by cell of source, language and topic; the cells' weights are raked to the
target shares of each, one dimension after the other, never above the tokens that a cell has; the
weight of a cell over its tokens is the probability with which each of its documents is sampled.

The levels are those that the targets name, all others together make ``*``. So there are at most
(sources + 1) (languages + 1) (topics + 1) cells, whatever the corpus: a sum before a shuffle makes
them, and they are few enough for the driver and for a broadcast.

A null level falls under ``*``, a null text has no tokens; a cell without tokens gets the plain fraction;
target shares of levels that have no tokens go to the others in proportion. An md5 of the key decides,
so repeated rows are sampled alike, and null keys like one key. No rows give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REST = "*"


@dataclass(frozen=True)
class Plan:
    """Target shares by level (``*``: all that aren't named), the fraction of tokens to keep, and topics.

    topics: name and regular expression (of Java and RE2 alike), the first that a text has is its topic.
    needles: by name, strings of which every match of its expression has one; texts without are passed by quickly.
    """

    sources: dict[str, float]
    languages: dict[str, float]
    topics: dict[str, float]
    rules: tuple[tuple[str, str], ...]
    needles: tuple[tuple[str, tuple[str, ...]], ...] = ()
    fraction: float = 0.6
    rounds: int = 40
    seed: str = "mix-1"


#: What the registered query and the pipeline use.
PLAN = Plan(
    sources={"src0": 0.25, "src1": 0.08, "src2": 0.08, REST: 0.59},
    languages={"en": 0.55, "de": 0.15, "es": 0.12, "fr": 0.15, REST: 0.03},
    topics={"legal": 0.02, "contact": 0.08, "web": 0.05, REST: 0.85},
    rules=(("legal", "[Ll]icen[cs]ed? |[Cc]opyright|[Ll]icense"), ("contact", "[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z]+"), ("web", "https?://|www[.]")),
    needles=(("legal", ("icen", "opyright")), ("contact", ("@",)), ("web", ("http", "www."))),
)

WORD = r"[^\x20\x09-\x0D]+"


def topic(text: Column, plan: Plan) -> Column:
    out, needles = F.lit(REST), dict(plan.needles)
    for name, pattern in reversed(plan.rules):
        hit = text.rlike(pattern)
        if there := [F.contains(text, F.lit(x)) for x in needles.get(name, ())]:
            hit = reduce(Column.__or__, there) & hit
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def level(value: Column, targets: dict[str, float]) -> Column:
    return F.when(value.isin([k for k in targets if k != REST]), value).otherwise(F.lit(REST))


def rake(cells: dict[tuple[str, str, str], int], plan: Plan) -> dict[tuple[str, str, str], float]:
    """The probability of each cell."""
    total = sum(cells.values())
    weight = {c: n * plan.fraction for c, n in sorted(cells.items()) if n}
    shares = []
    for k, targets in enumerate((plan.sources, plan.languages, plan.topics)):
        there = {c[k] for c in weight}
        named = sum(v for x, v in targets.items() if x in there)
        shares.append({x: targets.get(x, 0.0) / named * plan.fraction * total if named else None for x in there})
    for _ in range(plan.rounds):
        for k, share in enumerate(shares):
            sums: dict[str, float] = {}
            for c, w in weight.items():
                sums[c[k]] = sums.get(c[k], 0.0) + w
            for c in weight:
                if share[c[k]] is not None and sums[c[k]] > 0:
                    weight[c] = min(weight[c] * share[c[k]] / sums[c[k]], float(cells[c]))
    return {c: weight[c] / n if n else plan.fraction for c, n in cells.items()}


def gaps(cells: dict[tuple[str, str, str], int], plan: Plan = PLAN) -> list[tuple[str, str, float, float]]:
    """(dimension, level, target share, share that the calibrated weights reach), for levels that have tokens.

    Targets are out of reach where a level hasn't tokens enough, or where those of two dimensions contradict each
    other; raking then ends near them, and this tells how near.
    """
    chance = rake(cells, plan)
    weight = {c: chance[c] * n for c, n in cells.items() if n}
    total, out = sum(weight.values()) or 1.0, []
    for k, (name, targets) in enumerate((("source", plan.sources), ("language", plan.languages), ("topic", plan.topics))):
        there = sorted({c[k] for c in weight})
        named = sum(targets.get(x, 0.0) for x in there) or 1.0
        out += [(name, x, targets.get(x, 0.0) / named, sum(w for c, w in weight.items() if c[k] == x) / total) for x in there]
    return out


def calibrated(docs: DataFrame, plan: Plan = PLAN, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """``docs`` and _source, _lang, _topic (levels), _n_tokens, _probability and _sampled, which replace columns of these names."""
    docs = docs.drop("_source", "_lang", "_topic", "_n_tokens", "_probability", "_sampled")
    whole = F.coalesce(F.col(text), F.lit(""))
    levels = docs.withColumns(
        {
            "_source": level(F.col(source), plan.sources),
            "_lang": level(F.col(lang), plan.languages),
            "_topic": topic(whole, plan),
            "_n_tokens": F.regexp_count(whole, F.lit(WORD)).cast("long"),
        }
    )
    cells = {tuple(r[:3]): int(r[3]) for r in levels.groupBy("_source", "_lang", "_topic").agg(F.sum("_n_tokens")).collect()}
    most = math.prod(len(t) + 1 for t in (plan.sources, plan.languages, plan.topics))
    if len(cells) > most:
        raise ValueError(f"more than {most} cells")
    chances = docs.sparkSession.createDataFrame([(*c, p) for c, p in rake(cells, plan).items()] , "_source string, _lang string, _topic string, _probability double")
    made = levels.join(F.broadcast(chances), ["_source", "_lang", "_topic"])
    name = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(f"|{plan.seed}"))
    chance = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / 2**32
    return made.withColumn("_sampled", chance < F.col("_probability")).select(*docs.columns, "_source", "_lang", "_topic", "_n_tokens", "_probability", "_sampled")


def sample(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """The sampled rows with their own columns, whatever these are called."""
    own = {c: f"_own{k}" for k, c in enumerate(docs.columns)}
    made = calibrated(docs.toDF(*own.values()), plan, *(own[c] for c in ("doc_id", "text", "source", "lang")))
    return made.where("_sampled").select(*own.values()).toDF(*docs.columns)


def sql(plan: Plan = PLAN) -> str:
    """The same over ``documents``, for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    named = lambda c, t: f"case when {c} in ({', '.join(quote(k) for k in t if k != REST)}) then {c} else '*' end"
    rules = "".join(f" when regexp_matches(coalesce(text, ''), {quote(p)}) then {quote(n)}" for n, p in plan.rules)
    values = lambda t: ", ".join(f"({quote(k)}, {v!r}::double)" for k, v in t.items())
    step, inner = "", "r"
    for k, c in enumerate(("source", "lang", "topic")):
        inner = f"(select source_level, lang_level, topic_level, n, it, source_goal, lang_goal, topic_goal, case when {c}_goal is not null and sum(w) over (partition by {c}_level) > 0 then least(w * {c}_goal / sum(w) over (partition by {c}_level), n) else w end as w from {inner} {'where it < ' + str(plan.rounds) if not k else ''}) as r{k}"
    step = f"select source_level, lang_level, topic_level, n, it + 1 as it, source_goal, lang_goal, topic_goal, w from {inner}"
    goals = ", ".join(f"{c}_goals as (select level, share / sum(share) over () * {plan.fraction!r}::double * (select sum(n) from cells) as goal from (values {values(t)}) as v(level, share) where level in (select {c}_level from cells where n > 0))" for c, t in (("source", plan.sources), ("lang", plan.languages), ("topic", plan.topics)))
    return f"""
        with recursive d as (select doc_id, {named('source', plan.sources)} as source_level, {named('lang', plan.languages)} as lang_level,
            case{rules} else '*' end as topic_level, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as n_tokens from documents),
        cells as (select source_level, lang_level, topic_level, sum(n_tokens)::double as n from d group by all),
        {goals},
        r as (
            select c.*, 0 as it, s.goal as source_goal, l.goal as lang_goal, t.goal as topic_goal, n * {plan.fraction!r}::double as w
            from cells as c left join source_goals as s on s.level = source_level left join lang_goals as l on l.level = lang_level left join topic_goals as t on t.level = topic_level
            where n > 0
            union all {step}),
        p as (select c.source_level, c.lang_level, c.topic_level, coalesce(r.w / c.n, {plan.fraction!r}::double) as probability from cells as c
            left join r on r.it = {plan.rounds} and r.source_level = c.source_level and r.lang_level = c.lang_level and r.topic_level = c.topic_level)
        select doc_id, source_level, lang_level, topic_level, n_tokens, round(probability, 6) as probability,
            ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || '|{plan.seed}'), 1, 8))::bigint / 4294967296.0::double < probability as sampled
        from d join p using (source_level, lang_level, topic_level)"""
