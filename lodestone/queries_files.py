"""Registered queries of readers and writers: tables go out in a file's format and come back, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as X
from .operators import metrics, network, topics
from .queries import _ROC, _SCORES, _V, docs_of, names_of, paper_label, query, r, scores_of, vecs, view_of
from .session import scratch, table
from .sources import readers, sinks


@query("select 'PMID' || doc_id || '_1' as doc, 1990 + doc_id % 30 as year, array_to_string(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> ''), ' ') as words from documents".replace("\\\\", "\\"))
def document_lines(s, d):
    """Documents as lines of label, year and tokens, and back."""
    rows = docs_of(s, d).join(table(s, d, "documents").select(paper_label().alias("doc"), (1990 + F.col("doc_id") % 30).alias("year")), "doc")
    path = scratch(s, "lines")
    sinks.documents(rows, path)
    parts = F.split("value", " ", 3)
    return readers.lines(s, path, F.length("value") > 0).select(parts[0].alias("doc"), parts[1].cast("long").alias("year"), F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("words"))


@query("select row_number() over (order by label) - 1 as id, label from (select distinct c_name as label from customer union select s_name from supplier)")
def label_file(s, d):
    """Labels in order, one a line; their numbers are ids."""
    names = table(s, d, "customer").select(F.col("c_name").alias("value")).union(table(s, d, "supplier").select("s_name")).distinct()
    path = scratch(s, "labels")
    names.sort("value").write.text(path)
    return readers.label_file(s, path)


def labelled(s, d):
    """Vectors whose labels are papers, concepts and words in turn."""
    k = F.col("vec_id").cast("string")
    label = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("PMID"), k, F.lit("_1"))).when(F.col("vec_id") % 3 == 1, F.concat(F.lit("C"), k)).otherwise(F.concat(F.lit("w"), k))
    return vecs(s, d).select(label.alias("label"), "vec")


_LABELLED = "n as (select case vec_id % 3 when 0 then 'PMID' || vec_id || '_1' when 1 then 'C' || vec_id else 'w' || vec_id end as label, list_transform(embedding, lambda x: round(x::double, 5) + 0.0) as vec, vec_id from embeddings)"


def _rounded(df):
    return df.select("label", F.transform("vec", lambda x: r(x, 5) + 0.0).alias("vec"))


@query(f"with {_LABELLED} select label, vec from n")
def vector_file(s, d):
    path = scratch(s, "vectors")
    sinks.vectors(labelled(s, d), path)
    return _rounded(readers.vectors(s, path))


@query(f"with {_LABELLED} select label, vec from n where vec_id % 7 = 0 and vec_id % 3 <> 2")
def tag_routed_vectors(s, d):
    """Only the kinds that are asked for are read; each label asked for must be there."""
    path = scratch(s, "vectors")
    sinks.vector_tables(labelled(s, d), path)
    asked = vecs(s, d).where("vec_id % 7 = 0 and vec_id % 3 <> 2").select("vec_id")
    k = F.col("vec_id").cast("string")
    asked = asked.select(F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("PMID"), k, F.lit("_1"))).otherwise(F.concat(F.lit("C"), k)).alias("label"))
    return _rounded(readers.vectors_of(s.read.parquet(path), asked, strict=True))


@query(f"with {_LABELLED}, w as (select label, vec from n where label not in ('w2')) select label from w where length(label) > 1")
def vector_cleanup(s, d):
    """Words of one character and the sentence end have no vector."""
    rows = labelled(s, d).select(F.when(F.col("label") == "w2", "</s>").otherwise(F.col("label")).alias("label")).union(s.createDataFrame([("x",)], "label string"))
    return rows.where(X.keep_vector_words(F.col("label")))


@query(r"""select doc_id, regexp_replace(regexp_replace(text, '\s\.(\s|$)', '\1', 'g'), '\s\.(\s|$)', '\1', 'g') as text from (select doc_id, replace(replace(text, '.', ' . '), '  ', ' ') as text from documents)""".replace("\\\\", "\\"))
def lone_periods(s, d):
    spread = F.replace(F.replace("text", F.lit("."), F.lit(" . ")), F.lit("  "), F.lit(" "))
    return table(s, d, "documents").select("doc_id", X.remove_lone_periods(spread).alias("text"))


_XML = r"""x as (select doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g') as t from documents),
    y as (select doc_id, trim(t[1:30]) as title, trim(t[31:200]) as body from x)"""


@query(f"with {_XML} select 'PMID' || doc_id || '_' || (1 + doc_id % 2) as doc, 1980 + doc_id % 40 as year, title || ' . ' || body as text from y where doc_id % 10 <> 3 and doc_id % 11 <> 0 and not starts_with(title, 'Retracted') and 1980 + doc_id % 40 <= 2010")
def article_extraction(s, d):
    """XML articles, some of them comments or retracted, up to a year."""
    t = table(s, d, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " ").alias("t"))
    title, body = F.trim(F.substring("t", 1, 30)), F.trim(F.substring("t", 31, 170))
    kind = F.when(F.col("doc_id") % 10 == 3, "Comment").otherwise("Journal Article")
    year = lambda c: F.concat(F.lit("<PubMedPubDate><Year>"), (c).cast("string"), F.lit("</Year></PubMedPubDate>"))
    first = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("Retracted: "), title)).otherwise(title)
    made = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID Version=\""), (1 + F.col("doc_id") % 2).cast("string"), F.lit("\">"), F.col("doc_id").cast("string"),
        F.lit("</PMID><Article><ArticleTitle>"), first, F.lit("</ArticleTitle><Abstract><AbstractText>"), body, F.lit("</AbstractText></Abstract><PublicationTypeList><PublicationType>"), kind,
        F.lit("</PublicationType></PublicationTypeList></Article></MedlineCitation><PubmedData><History>"), year(1980 + F.col("doc_id") % 40), year(F.lit(2024)), F.lit("</History></PubmedData></PubmedArticle>"),
    )
    path = scratch(s, "articles")
    sets = t.groupBy((F.col("doc_id") % 4).alias("part")).agg(F.concat(F.lit("<PubmedArticleSet>"), F.array_join(F.collect_list(made), "\n"), F.lit("</PubmedArticleSet>")).alias("value"))
    sets.write.partitionBy("part").text(path)
    return readers.extract_articles(readers.articles_xml(s, path), until=2010).select("doc", F.col("year").cast("long").alias("year"), "text")


def piped(s, rows, path, columns):
    """Writes (a, …) of columns by their number, from 1, as a pipe-delimited table."""
    fields = [F.coalesce(columns[k], F.lit("")) if k in columns else F.lit(f"c{k}") for k in range(1, max(columns) + 2)]
    rows.select(F.concat_ws("|", *fields).alias("value")).write.text(path)


@query("select 'C' || p_size as label, string_agg(distinct p_type, ' ' order by p_type) as text from part group by p_size")
def concept_texts(s, d):
    """Different texts of each concept, from a pipe-delimited table."""
    path = scratch(s, "concepts")
    piped(s, table(s, d, "part"), path, {1: F.concat(F.lit("C"), F.col("p_size").cast("string")), 15: F.col("p_type")})
    return readers.distinct_texts(readers.concept_texts(s, path))


@query("select 'C' || p_partkey as label, p_type as text from part")
def concept_texts_cut(s, d):
    """Texts up to the first full stop."""
    path = scratch(s, "concepts")
    piped(s, table(s, d, "part"), path, {1: F.concat(F.lit("C"), F.col("p_partkey").cast("string")), 15: F.concat("p_type", F.lit(". And "), "p_name")})
    return readers.concept_texts(s, path, cut=True)


_CODES = ["SY", "RL", "RQ", "PAR", "CHD", "SIB", "RB", "RN", "AQ", "RO", "QB", "RU", "XX", "DEL"]


@query(f"""with c as (select {_CODES!r} as codes), l as (select 'C' || l_partkey as x, 'C' || (l_suppkey + 7) as y, codes[1 + (l_orderkey + l_linenumber) % 14] as rel from lineitem, c),
    w as (select x, y, case when rel in ('SY', 'RL', 'RQ') then 0.1 when rel in ('PAR', 'CHD', 'SIB', 'RB', 'RN') then 0.5 else 1.0 end::double as w from l where rel not in ('XX', 'DEL') and x <> y)
    select least(x, y) as a, greatest(x, y) as b, min(w) as w from w group by all""")
def relation_table(s, d):
    """All codes of relations, known and unknown ones, from a pipe-delimited table."""
    codes = F.array(*map(F.lit, _CODES))
    path = scratch(s, "relations")
    rel = F.get(codes, ((F.col("l_orderkey") + F.col("l_linenumber")) % 14).cast("int"))
    piped(s, table(s, d, "lineitem"), path, {1: F.concat(F.lit("C"), F.col("l_partkey").cast("string")), 4: rel, 5: F.concat(F.lit("C"), (F.col("l_suppkey") + 7).cast("string"))})
    return network.relation_edges(readers.concept_relations(s, path))


@query("select 'S' || s_suppkey as a, 'N' || s_nationkey as b, case when s_suppkey % 5 = 0 then 0.0 else s_suppkey / 8.0 end::double as w from supplier")
def text_edges(s, d):
    """Lines of two labels and a weight; what is no number counts as 0."""
    weight = F.when(F.col("s_suppkey") % 5 == 0, "none").otherwise((F.col("s_suppkey") / 8).cast("string"))
    path = scratch(s, "edges")
    sinks.edges(table(s, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("a"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("b"), weight.alias("w")), path)
    return readers.text_edges(s, path)


_VIEW = f"{_V}, view as (select label as topic, name as word, 1 + vec_id % 10 as cnt, row_number() over (partition by label order by 1 + vec_id % 10 desc, vec_id) - 1 as rank from v)"


@query(f"with {_VIEW} select topic::bigint as topic, rank, word, cnt from view")
def topic_view_file(s, d):
    """A view as lines, topics one after the other, and back."""
    path = scratch(s, "view")
    lines = sinks.view_lines(view_of(s, d).select("topic", "rank", "word", "cnt"))
    lines.repartitionByRange("topic", "pos").sortWithinPartitions("topic", "pos").select("value").write.text(path)
    return readers.topic_view(s, path).select(F.col("topic").cast("long").alias("topic"), F.col("rank").cast("long").alias("rank"), "word", "cnt")


@query(f"with {_SCORES} select metric, positive, score, count(*) as n from sc group by all")
def evaluation_files(s, d):
    """Scores as evaluation files of positives and negatives, and back."""
    paths = []
    for positive in (True, False):
        rows = scores_of(s, d).where(F.col("positive") == positive).select("metric", "score", F.lit(None).cast("array<struct<topic:int,words:array<string>>>").alias("topics"))
        paths.append(scratch(s, "evals"))
        sinks.evaluation_lines(rows).write.text(paths[-1])
    return readers.evaluations(s, [paths[0]], [paths[1]]).groupBy("metric", "positive", "score").agg(F.count("*").alias("n"))


@query("select * from (values ('L2', -0.5::double, 1.5::double, 0.0::double, 2.0::double), ('CSim', 0.25, 1.0, -1.0, 2.0), ('TopicNetMod', 0.125, 3.0, 0.0, 1.0)) as t(metric, coef, exponent, min, range)")
def parameter_file(s, d):
    path = scratch(s, "parameters")
    sinks.parameters([("L2", -0.5, 1.5, 0.0, 2.0), ("CSim", 0.25, 1.0, -1.0, 2.0), ("TopicNetMod", 0.125, 3.0, 0.0, 1.0)], s, path)
    return readers.parameters(s, path, metrics.METRICS, [])


@query("select n_name || case when n_regionkey < 2 then '*' else '' end as source, 'Topic_' || n_regionkey as target, n_nationkey / 4.0 as weight from nation")
def topic_network_csv(s, d):
    rows = [(r["n_name"] + "*" * (r["n_regionkey"] < 2), f"Topic_{r['n_regionkey']}", r["n_nationkey"] / 4) for r in table(s, d, "nation").collect()]
    path = scratch(s, "net")
    sinks.topic_network(rows, table(s, d, "nation"), path)
    return s.read.csv(path, header=True, schema="Source string, Target string, Weight double").toDF("source", "target", "weight")


@query(f"with {_VIEW} select topic, to_json({{'name': 'Topic_' || topic, 'children': list({{'name': word, 'size': cnt::varchar}} order by rank)}})::varchar as json from view where rank < 100 group by topic")
def topics_json(s, d):
    return sinks.topics_json(view_of(s, d).select("topic", "rank", "word", "cnt"))


@query("""with m as (select vec_id::varchar as paper, embedding as mix from embeddings), s as (select paper, unnest(range(len(mix))) as topic, round(unnest(mix)::double, 4) as score from m),
    t as (select topic, paper, row_number() over (partition by topic order by score desc, encode(paper) desc) as rank from s qualify rank <= 10),
    h as (select page_id::varchar as paper, url as title from pages where page_id % 2 = 0)
    select topic, to_json({'topic': 'Topic_' || topic, 'papers': list({'pmid': paper, 'title': title} order by rank)})::varchar as json from t left join h using (paper) group by topic""")
def papers_json(s, d):
    """The best papers of each topic with their titles; null where one isn't known."""
    rows = table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("paper"), F.posexplode("embedding").alias("topic", "x"))
    best = topics.top_papers(rows.select(F.col("topic").cast("long").alias("topic"), "paper", r(F.col("x").cast("double"), 4).alias("score")), 10)
    titles = table(s, d, "pages").where("page_id % 2 = 0").select(F.col("page_id").cast("string").alias("paper"), F.col("url").alias("title"))
    return sinks.papers_json(best, titles)


@query("""with m as (select vec_id::varchar as paper, embedding as mix from embeddings), s as (select paper, unnest(range(len(mix))) as topic, round(unnest(mix)::double, 4) as score from m),
    t as (select topic, paper, row_number() over (partition by topic order by score desc, encode(paper) desc) as rank from s qualify rank <= 5)
    select topic, 'Topic_' || topic || ' ' || string_agg(paper, ' ' order by rank) as value from t group by topic""")
def paper_lines(s, d):
    rows = table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("paper"), F.posexplode("embedding").alias("topic", "x"))
    return sinks.paper_lines(topics.top_papers(rows.select(F.col("topic").cast("long").alias("topic"), "paper", r(F.col("x").cast("double"), 4).alias("score")), 5))


@query(f"""with {_VIEW}, t as (select topic, list(word order by rank) as words from view where rank < 5 group by topic)
    select 'TopicWalk' || (topic % 3) as metric, 'TopicWalk' || (topic % 3) || chr(9) || '0.5' || string_agg(chr(9) || 'Topic_' || topic || ' ' || array_to_string(words, ' '), '' order by topic) as value,
        to_json({{'name': 'TopicWalk' || (topic % 3), 'score': 0.5::double, 'topics': list(words order by topic)}})::varchar as json from t group by topic % 3""")
def evaluation_report(s, d):
    """A metric's line and JSON with the first five words of its topics."""
    first = view_of(s, d).where("rank < 5").groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("l")).select("topic", F.col("l.word").alias("words"))
    rows = first.groupBy(F.concat(F.lit("TopicWalk"), (F.col("topic") % 3).cast("string")).alias("metric")).agg(F.array_sort(F.collect_list(F.struct("topic", "words"))).alias("topics")).withColumn("score", F.lit(0.5))
    lines = sinks.evaluation_lines(rows).select(F.split("value", "\t")[0].alias("metric"), "value")
    return lines.join(sinks.eval_json(rows).select(F.get_json_object("json", "$.name").alias("metric"), "json"), "metric")


@query("""with o as (select 'PMID' || o_orderkey || '_1' as doc, year(o_orderdate) as y, string_split(lower(o_orderpriority), '-') as tokens from orders), s as (select (y - min(y) over ()) // 2 as slice, doc, unnest(tokens) as term from o),
    v as (select term, row_number() over (order by term) - 1 as term_id from (select distinct term from s)), c as (select slice, doc, term_id, term, count(*) as cnt from s join v using (term) group by all),
    m as (select len(list(term_id)) || ' ' || string_agg(term_id || ':' || cnt, ' ' order by term_id) as line from c group by slice, doc), q as (select count(distinct doc)::varchar as line from c group by slice), w as (select distinct term_id || chr(9) || '"' || term || '"' as line from c)
    select 'mult' as file, line, count(*) as n from m group by all union all select 'seq', line, count(*) from q group by all union all select 'words', line, count(*) from w group by all""")
def time_slice_files(s, d):
    """The three files of a time-sliced corpus."""
    from .operators import corpus
    from .queries import dated

    path, out = scratch(s, "dtm"), None
    sinks.time_slice_files(corpus.time_slice_terms(dated(s, d), 2), path)
    for name in ("mult", "seq", "words"):
        one = s.read.text(f"{path}-{name}").groupBy(F.lit(name).alias("file"), F.col("value").alias("line")).agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""with {_ROC.replace("sc as (", "raw as (").replace("k as (", "sc as (select metric, doc_id, positive, case when metric = 'words' then -score else score end as score from raw), k0 as (select 1), k as (", 1)},
    l as (select metric, pos, score, tpr, fpr, lag(tpr) over w as t0, lag(fpr) over w as f0 from pts window w as (partition by metric order by pos)),
    u as (select metric, sum((fpr - f0) * (tpr + t0) / 2) as auc from l group by metric)
    select metric, round(case when auc < 0.5 then 1 - auc else auc end, 6) as auc from u""")
def roc_report_flipped(s, d):
    """Areas, with the sign of a metric's scores turned where its area is under a half."""
    from .operators import training

    scores = scores_of(s, d).withColumn("score", F.when(F.col("metric") == "words", -F.col("score")).otherwise(F.col("score")))
    return training.report(scores, above=True).select("metric", r("auc").alias("auc"))


@query(f"""with {_SCORES}, g as (select metric, 100.0::double as lo, 1000.0::double as rg from sc group by metric), p(metric, coef, ex) as (values ('chars', 0.5::double, 2.0::double), ('words', -0.25::double, 1.5::double))
    select doc_id as name, round(sum(case when score >= lo then coef * pow((score - lo) / rg, ex) else 0 end), 6) as score from sc join g using (metric) join p using (metric) group by doc_id""")
def poly_below_minimum(s, d):
    """Scores under their metric's minimum add nothing."""
    coef = s.createDataFrame([("chars", 0.5, 2.0, 100.0, 1000.0), ("words", -0.25, 1.5, 100.0, 1000.0)], "metric string, coef double, exponent double, min double, range double")
    return metrics.polynomial(scores_of(s, d), coef, ["name"]).select("name", r("score").alias("score"))


@query("select label from (select distinct c_name as label from customer) where label not in (select c_name from customer where c_custkey % 4 > 0)")
def missing_words(s, d):
    """Words that no label equals, of which there are some."""
    names = table(s, d, "customer")
    return X.unknown_words(names.select(F.col("c_name").alias("word")), names.where("c_custkey % 4 > 0").select(F.col("c_name").alias("label"))).withColumnRenamed("word", "label")
