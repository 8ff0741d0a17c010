"""The pipeline against the same decisions made text by text, by other code than the stages'."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken
import xxhash
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from lodestone.llm import mixing, quality_rules

from .test_learned_queries import judged, plain_ftrl, slots

D = "/root/testdata/sf0.001"


def kept_by_toxicity(rows, labels):
    known = {r.doc_id: r.toxic for r in labels if r.toxic is not None and r.doc_id in rows and zlib.crc32(str(r.doc_id).encode()) % 5}
    score = plain_ftrl([(slots(rows[k].text), known[k]) for k in sorted(known, key=lambda k: xxhash.xxh64_intdigest(str(k)))])
    return {k for k, r in rows.items() if score(slots(r.text)) < 0.5}


def kept_by_similarity(rows):
    """The smallest key of each component of links at a Jaccard similarity of 0.8 on five-word shingles."""
    sets, holders, both, roots = {}, defaultdict(list), Counter(), {k: k for k in rows}
    for k in sorted(rows):
        w = rows[k].text.lower().split()
        sets[k] = set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else {tuple(w)}
        for g in sets[k]:
            both.update((o, k) for o in holders[g])
            holders[g].append(k)

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for (a, b), n in both.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            roots[max(x, y)] = min(x, y)
    return {k for k in rows if find(k) == k}


def kept_by_mixing(rows):
    """Raking by plain loops, then a draw by md5."""
    plan, level = mixing.PLAN, {}
    for k, r in rows.items():
        topic = next((n for n, p in plan.rules if re.search(p, r.text)), "*")
        level[k] = (r.source if r.source in plan.sources else "*", r.lang if r.lang in plan.languages else "*", topic)
    cells = Counter()
    for k, r in rows.items():
        cells[level[k]] += len(r.text.split())
    goal = plan.fraction * sum(cells.values())
    weight = {c: n * plan.fraction for c, n in cells.items() if n}
    for _ in range(plan.rounds):
        for k, targets in enumerate((plan.sources, plan.languages, plan.topics)):
            there = {c[k] for c in weight}
            named = sum(v for x, v in targets.items() if x in there)
            now = Counter()
            for c, w in weight.items():
                now[c[k]] += w
            weight = {c: min(w * targets.get(c[k], 0) / named * goal / now[c[k]], cells[c]) for c, w in weight.items()}
    draw = lambda k: int(hashlib.md5(f"{k}|{plan.seed}".encode()).hexdigest()[:8], 16) / 2**32
    return {k for k in rows if draw(k) < weight[level[k]] / cells[level[k]]}


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, D)
        assert made.columns == columns
        if name == "toxicity":
            want = kept_by_toxicity(rows, labels.collect())
        elif name == "quality_rules":
            rules = quality_rules.fit(docs, labels)
            want = {k for k, r in rows.items() if judged(rules, r.text)[2]}
        else:
            want = kept_by_similarity(rows) if name == "near_duplicates" else kept_by_mixing(rows)
        docs = spark.createDataFrame(made.collect(), made.schema)
        assert {r.doc_id for r in docs.collect()} == want and 0 < len(want) < len(rows), name
        rows = {r.doc_id: r for r in docs.collect()}
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(corpus_pipeline.TOKENIZER), special_tokens={})
    final = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, D).collect()}
    assert {k: r.ids for k, r in final.items()} == {k: enc.encode_ordinary(r.text) for k, r in rows.items()}
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, D).collect()) == sorted((k, len(r.ids)) for k, r in final.items())


def test_empty_and_odd_rows(spark):
    """Null and empty texts are clean, but fail the quality rules; they are one group of copies; repeated rows are drawn alike."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, fp int, _sampled string"
    long = "word " * 50
    rows = [(1, None, None, None, None, "a", 1, "b"), (None, f"{long}x", "en", "s", 1, "a", 1, "b"), (2, "", "en", "s", 1, "a", 1, "b"), (2, "", "en", "s", 1, "a", 1, "b")]
    odd = spark.createDataFrame(rows, schema)
    tables = lambda df: sorted(map(tuple, df.collect()), key=repr)
    stages = dict(corpus_pipeline.STAGES)
    assert tables(stages["toxicity"](spark, odd, D)) == sorted(rows, key=repr)
    assert tables(stages["quality_rules"](spark, odd, D)) == []
    # The empty texts are one component, named by its smallest key; the row without a key is another.
    assert tables(stages["near_duplicates"](spark, odd, D)) == sorted(rows[:2], key=repr)
    mixed = tables(stages["mixing"](spark, odd, D))
    assert all(mixed.count(r) in (0, rows.count(r)) for r in set(rows)) and set(mixed) <= set(rows)
    ends = stages["bpe"](spark, odd, D).collect()
    assert sorted((r.doc_id or 0, r.n_tokens > 0, len(r.ids) == r.n_tokens) for r in ends) == [(0, True, True), (1, False, True), (2, False, True), (2, False, True)]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), D).isEmpty()
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_duplicates", "mixing", "bpe"]
