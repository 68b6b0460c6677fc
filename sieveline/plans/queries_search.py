"""Queries of the lexical and dense indexes, rankings, fusion, the call graph and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline import constants as C
from sieveline.functions import text as T
from sieveline.operators import dense, graph, lexical, rank
from sieveline.plans import api, search
from sieveline.plans import sql as S
from sieveline.plans.registering import query
from sieveline.plans.standins import CORPUS, UNITS, corpus, table, units
from sieveline.sources import store
from sieveline.sources.scratch import new_path, written

_DOCS = f"docs AS (SELECT doc_id AS ordinal, {S.tokenize('text')} AS tokens FROM d)"
_ITEMS = f"items AS (SELECT item_id AS query_id, {S.tokenize('text')} AS tokens FROM benchmark)"
_BM = f"WITH {UNITS},\n{_DOCS},\n{_ITEMS},\n{S.bm25('docs', 'items')}"


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("ordinal"), T.tokenize(F.coalesce("text", F.lit(""))).alias("tokens"))


def _items(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), T.tokenize("text").alias("tokens"))


@query("bm25_postings", f"{_BM} SELECT term, ordinal, tf FROM bm_post")
def bm25_postings(spark, sf):
    return lexical.postings(_docs(spark, sf)).select("term", "ordinal", F.col("tf").cast("long").alias("tf"))


@query("bm25_idf", f"{_BM} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) AS idf FROM bm_terms CROSS JOIN bm_corpus")
def bm25_idf(spark, sf):
    docs = _docs(spark, sf)
    return lexical.terms(lexical.postings(docs), lexical.corpus(docs)).select("term", "df", F.round("idf", 9).alias("idf"))


@query("bm25_scores", f"{_BM} SELECT query_id, ordinal, round(score, 6) AS score FROM bm")
def bm25_scores(spark, sf):
    return lexical.scores(_docs(spark, sf), _items(spark, sf)).select("query_id", "ordinal", F.round("score", 6).alias("score"))


@query("bm25_topk", f"{_BM}, every AS ({S.filled('bm', 'items', 'docs', 10)}), r AS ({S.ranked('every')}) SELECT query_id, ordinal, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def bm25_topk(spark, sf):
    docs, items = _docs(spark, sf), _items(spark, sf)
    found = rank.rank_order(rank.fill(lexical.scores(docs, items), items, docs, 10), 10)
    return found.select("query_id", "ordinal", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("rank_order", "SELECT l_partkey % 50 AS query_id, l_orderkey * 8 + l_linenumber AS ordinal, row_number() OVER (PARTITION BY l_partkey % 50 ORDER BY l_quantity DESC, l_orderkey * 8 + l_linenumber) AS rank FROM lineitem")
def rank_order(spark, sf):
    scored = table(spark, sf, "lineitem").select((F.col("l_partkey") % 50).alias("query_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordinal"), F.col("l_quantity").alias("score"))
    return rank.rank_order(scored).select("query_id", "ordinal", F.col("rank").cast("long").alias("rank"))


@query("l2_normalise", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS first FROM embeddings")
def l2_normalise(spark, sf):
    x = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", F.round(dense.dot(x, x), 6).alias("norm"), F.round(dense.l2_normalise(x)[0], 6).alias("first"))


_DENSE = "SELECT q.vec_id AS query_id, d.vec_id AS ordinal, list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS score FROM embeddings q CROSS JOIN embeddings d WHERE q.vec_id % 100 = 0"


@query("dense_topk", f"WITH every AS ({_DENSE}), r AS ({S.ranked('every')}) SELECT query_id, ordinal, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def dense_topk(spark, sf):
    """Queries are the vectors whose id is divisible by 100, against all."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ordinal"), "embedding")
    wanted = vectors.where("ordinal % 100 = 0").select(F.col("ordinal").alias("query_id"), "embedding")
    found = rank.rank_order(dense.best(vectors, wanted, 10), 10)
    return found.select("query_id", "ordinal", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("validation_mrr", """WITH p AS (SELECT q.vec_id AS pair_id, q.embedding::DOUBLE[] AS q, d.embedding::DOUBLE[] AS d FROM embeddings q JOIN embeddings d ON d.vec_id = q.vec_id + 1),
s AS (SELECT a.pair_id, sum(CASE WHEN round(list_dot_product(a.q, b.d), 9) > round(list_dot_product(a.q, a.d), 9) THEN 1 ELSE 0 END) + 1 AS rank FROM p a CROSS JOIN p b GROUP BY a.pair_id)
SELECT count(*) AS n, round(avg(1.0 / rank), 6) AS mrr FROM s""")
def validation_mrr(spark, sf):
    return dense.validation_ranks(_vector_pairs(spark, sf)).agg(F.count("*").alias("n"), F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"))


def _vector_pairs(spark, sf):
    """Every vector with the one after it."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    left = vectors.select(F.col("vec_id").alias("pair_id"), F.col("embedding").alias("q"))
    return left.join(vectors.select((F.col("vec_id") - 1).alias("pair_id"), F.col("embedding").alias("d")), "pair_id")


@query("mnr_loss", """WITH p AS (SELECT q.vec_id AS pair_id, q.embedding::DOUBLE[] AS q, d.embedding::DOUBLE[] AS d FROM embeddings q JOIN embeddings d ON d.vec_id = q.vec_id + 1),
s AS (SELECT a.pair_id, b.pair_id AS other, 20.0 * list_dot_product(a.q, b.d) AS s FROM p a CROSS JOIN p b)
SELECT pair_id, round(ln(sum(exp(s))) - max(CASE WHEN pair_id = other THEN s END), 6) AS loss FROM s GROUP BY pair_id""")
def mnr_loss(spark, sf):
    return dense.mnr_loss(_vector_pairs(spark, sf)).select("pair_id", F.round("loss", 6).alias("loss"))


@query("embed_queries")
def embed_queries(spark, sf):
    """Vectors of prefixed queries by the plugged-in model."""
    items = table(spark, sf, "benchmark")
    prefixed = F.concat(T.query_prefix(F.lit("BAAI/bge-small-en-v1.5")), F.coalesce("text", F.lit("")))
    return items.select("item_id", dense.embed_column(prefixed).alias("v")).select("item_id", F.size("v").alias("dim"), F.round(dense.dot("v", "v"), 4).alias("norm"))


# Two rankings of the documents by language: by length and by id, of which fusion is computed.
_TWO = """a AS (SELECT lang AS query_id, doc_id AS ordinal, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
b AS (SELECT lang AS query_id, doc_id AS ordinal, row_number() OVER (PARTITION BY lang ORDER BY n_chars % 97 DESC, doc_id) AS rank FROM documents)"""


def _two(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("ordinal"), "n_chars")
    return [rank.rank_order(docs.withColumn("score", score.cast("double"))) for score in (F.col("n_chars"), F.col("n_chars") % 97)]


@query("rrf_plain", f"WITH {_TWO}, s AS (SELECT query_id, ordinal, 1.0::DOUBLE / (60 + rank) AS score FROM a UNION ALL SELECT query_id, ordinal, 1.0::DOUBLE / (60 + rank) FROM b) SELECT query_id, ordinal, round(sum(score), 9) AS score FROM s GROUP BY ALL")
def rrf_plain(spark, sf):
    return rank.rrf(_two(spark, sf)).select("query_id", "ordinal", F.round("score", 9).alias("score"))


@query("rrf_weighted", f"WITH {_TWO}, s AS (SELECT query_id, ordinal, 1.0::DOUBLE / (60 + rank) AS score FROM a WHERE rank <= 100 UNION ALL SELECT query_id, ordinal, 5.0::DOUBLE / (60 + rank) FROM b WHERE rank <= 100) SELECT query_id, ordinal, round(sum(score), 9) AS score FROM s GROUP BY ALL")
def rrf_weighted(spark, sf):
    return rank.rrf(_two(spark, sf), depth=C.FUSION_DEPTH, weights=[1.0, C.DENSE_WEIGHT]).select("query_id", "ordinal", F.round("score", 9).alias("score"))


# ---- the call graph
_EDGES = """calls AS (SELECT DISTINCT repo, id AS caller, file, unnest(w[2:]) AS call FROM units),
resolved AS (
  SELECT c.repo, c.caller, c.call, u.id AS callee FROM calls c JOIN units u ON u.repo = c.repo AND u.name = c.call AND u.file = c.file
  UNION ALL
  SELECT c.repo, c.caller, c.call, u.id FROM calls c JOIN units u ON u.repo = c.repo AND u.name = c.call
  WHERE NOT EXISTS (SELECT 1 FROM units v WHERE v.repo = c.repo AND v.name = c.call AND v.file = c.file) AND (NOT u.is_static OR u.file LIKE '%.h')
),
edges AS (SELECT DISTINCT repo, caller, callee FROM resolved),
nb AS (SELECT caller AS a, callee AS b FROM edges UNION SELECT callee, caller FROM edges)"""


@query("call_resolution", f"WITH {UNITS},\n{_EDGES} SELECT caller, call, callee FROM resolved")
def call_resolution(spark, sf):
    return graph.resolve_calls(units(spark, sf)).select("caller", "call", "callee")


@query("call_graph", f"""WITH {UNITS},
own AS (SELECT DISTINCT repo, name, file FROM units), made AS (SELECT DISTINCT repo, id, file, unnest(w[2:]) AS name FROM units)
SELECT 'call' AS kind, m.repo, m.id, m.name, coalesce(o.file, '') AS scope FROM made m LEFT JOIN own o ON o.repo = m.repo AND o.name = m.name AND o.file = m.file
UNION ALL SELECT 'definition', repo, id, name, file FROM units UNION ALL SELECT 'definition', repo, id, name, '' FROM units WHERE NOT is_static OR file LIKE '%.h'""")
def call_graph(spark, sf):
    """The graph as it is stored: a row for each call and for each scope of a definition, whatever the number of edges."""
    found = graph.call_graph(units(spark, sf))
    calls = found.calls.select(F.lit("call").alias("kind"), "repo", F.col("caller").alias("id"), "name", "scope")
    return calls.unionByName(found.definitions.select(F.lit("definition").alias("kind"), "repo", F.col("callee").alias("id"), "name", "scope"))


@query("call_edges", f"WITH {UNITS},\n{_EDGES} SELECT caller, callee FROM edges")
def call_edges(spark, sf):
    return graph.written_graph(units(spark, sf)).pairs()


@query("neighbours", f"WITH {UNITS},\n{_EDGES} SELECT a, b FROM nb")
def neighbours(spark, sf):
    return graph.neighbours(units(spark, sf))


@query("callers_of", f"WITH {UNITS},\n{_EDGES} SELECT callee AS id, string_agg(DISTINCT caller, ' ' ORDER BY caller) AS callers FROM edges GROUP BY callee")
def callers_of(spark, sf):
    return graph.written_graph(units(spark, sf)).callers(separator=" ").withColumnRenamed("related", "callers")


@query("callees_of", f"WITH {UNITS},\n{_EDGES} SELECT caller AS id, string_agg(DISTINCT callee, ' ' ORDER BY callee) AS callees FROM edges GROUP BY caller")
def callees_of(spark, sf):
    return graph.written_graph(units(spark, sf)).callees(separator=" ").withColumnRenamed("related", "callees")


_WANTED = "wanted AS (SELECT id AS query FROM units WHERE ordinal % 100 = 0 UNION SELECT name FROM units WHERE ordinal % 100 = 1 UNION SELECT ' no_such_name ')"


@query("find_function", f"WITH {UNITS}, {_WANTED} SELECT query, id FROM wanted JOIN units ON id = trim(query) OR (name = trim(query) AND NOT EXISTS (SELECT 1 FROM units v WHERE v.id = trim(query)))")
def find_function(spark, sf):
    own = units(spark, sf)
    names = own.where("ordinal % 100 = 0").select(F.col("id").alias("query")).union(own.where("ordinal % 100 = 1").select("name")).union(spark.range(1).select(F.lit(" no_such_name ")))
    return graph.find(own, names.distinct()).select("query", "id")


# ---- search over the documents that have a vector; queries are those whose id is divisible by 100
_SEARCH = f"""WITH {CORPUS},
docs AS (SELECT ordinal, {S.tokenize("file || ' ' || text")} AS tokens FROM corpus),
q AS (SELECT ordinal AS query_id, {S.tokenize('comment')} AS tokens, embedding FROM corpus WHERE ordinal % 100 = 0),
{S.bm25('docs', 'q')},
bm_full AS ({S.filled('bm', 'q', 'docs', 100)}),
dense AS (SELECT query_id, ordinal, list_dot_product(q.embedding::DOUBLE[], corpus.embedding::DOUBLE[]) AS score FROM q CROSS JOIN corpus),
r1 AS ({S.ranked('bm_full')}), r2 AS ({S.ranked('dense')}),
fused AS (SELECT query_id, ordinal, sum(score) AS score FROM (SELECT query_id, ordinal, 1.0::DOUBLE / (60 + rank) AS score FROM r1 WHERE rank <= 100 UNION ALL SELECT query_id, ordinal, 5.0::DOUBLE / (60 + rank) FROM r2 WHERE rank <= 100) GROUP BY ALL)"""
_EXPANDED = f"""{_EDGES.replace("FROM units", "FROM corpus").replace("JOIN units", "JOIN corpus")},
ord AS (SELECT id, ordinal FROM corpus), nbo AS (SELECT DISTINCT x.ordinal AS a, y.ordinal AS b FROM nb JOIN ord x ON x.id = nb.a JOIN ord y ON y.id = nb.b WHERE nb.a <> nb.b),
deg AS (SELECT a, count(*) AS d FROM nbo GROUP BY a),
fr AS ({S.ranked('fused', 12)}), seeds AS (SELECT query_id, ordinal, score FROM fr WHERE rank <= 3 AND score > 0),
gain AS (SELECT s.query_id, nbo.b AS ordinal, 0.5 * s.score / d AS score FROM seeds s JOIN nbo ON nbo.a = s.ordinal JOIN deg ON deg.a = s.ordinal WHERE NOT EXISTS (SELECT 1 FROM seeds t WHERE t.query_id = s.query_id AND t.ordinal = nbo.b)),
raised AS (SELECT query_id, ordinal, sum(score) AS score FROM (SELECT query_id, ordinal, score FROM fused UNION ALL SELECT * FROM gain) GROUP BY ALL),
marked AS (SELECT r.*, s.ordinal IS NOT NULL AS is_seed FROM raised r LEFT JOIN seeds s ON s.query_id = r.query_id AND s.ordinal = r.ordinal),
lim AS (SELECT query_id, max(CASE WHEN NOT is_seed THEN score END) AS rest, min(CASE WHEN is_seed THEN score END) AS least FROM marked GROUP BY query_id),
expanded AS (SELECT m.query_id, m.ordinal, m.score + CASE WHEN is_seed AND rest >= least THEN rest - least + 1e-9 ELSE 0 END AS score FROM marked m JOIN lim USING (query_id))"""


def _top(rows: str) -> str:
    return f"every AS ({S.filled(rows, 'q', 'docs', 10)}), top AS ({S.ranked('every', 12)}) SELECT query_id, rank, t.ordinal, round(t.score, 6) AS score"


def _index(spark, sf):
    own = written(corpus(spark, sf), "corpus")
    index = search.SearchIndex(own, vectors=own.select("ordinal", "embedding"))
    wanted = own.where("ordinal % 100 = 0").select(F.col("ordinal").alias("query_id"), T.tokenize("comment").alias("tokens"), "embedding")
    return index, wanted


def _found(index, wanted, method, k=10):
    return index.ranking(wanted, method, k).select("query_id", F.col("rank").cast("long").alias("rank"), "ordinal", F.round("score", 6).alias("score"))


@query("hybrid_topk", f"{_SEARCH}, {_top('fused')} FROM top t WHERE rank <= 10")
def hybrid_topk(spark, sf):
    return _found(*_index(spark, sf), "hybrid")


@query("graph_expand", f"{_SEARCH}, {_EXPANDED} SELECT query_id, ordinal, round(score, 9) AS score FROM expanded")
def graph_expand(spark, sf):
    index, wanted = _index(spark, sf)
    return index.scores(wanted, "hybrid_graph").select("query_id", "ordinal", F.round("score", 9).alias("score"))


@query("search_flagship", f"{_SEARCH}, {_EXPANDED}, {_top('expanded')}, c.id, c.file, c.name FROM top t JOIN corpus c ON c.ordinal = t.ordinal WHERE rank <= 10")
def search_flagship(spark, sf):
    index, wanted = _index(spark, sf)
    return _found(index, wanted, "hybrid_graph").join(index.units.select("ordinal", "id", "file", "name"), "ordinal").select("query_id", "rank", "ordinal", "score", "id", "file", "name")


@query("api_lookup", f"""WITH {UNITS},\n{_EDGES},
w AS (SELECT id FROM units WHERE ordinal % 100 = 0), cr AS (SELECT callee AS id, string_agg(DISTINCT caller, ' ' ORDER BY caller) AS callers FROM edges GROUP BY callee), ce AS (SELECT caller AS id, string_agg(DISTINCT callee, ' ' ORDER BY callee) AS callees FROM edges GROUP BY caller)
SELECT id, coalesce(callers, '') AS callers, coalesce(callees, '') AS callees FROM w LEFT JOIN cr USING (id) LEFT JOIN ce USING (id)""")
def api_lookup(spark, sf):
    """get_function for each unit whose id is divisible by 100."""
    own = units(spark, sf)
    wanted = own.where("ordinal % 100 = 0").select(F.col("id").alias("query"))
    found = api.function_details(search.SearchIndex(own), wanted)
    return found.select("id", F.array_join("callers", " ").alias("callers"), F.array_join("callees", " ").alias("callees"))


@query("index_roundtrip")
def index_roundtrip(spark, sf):
    """A saved and loaded index gives the same ranking."""
    index, wanted = _index(spark, sf)
    path = new_path(spark, "index")
    search.SearchIndex(index.units.drop("embedding"), vectors=index.vectors).save(path)
    return _found(search.SearchIndex.load(spark, path), wanted, "hybrid_graph")


@query("cache_reuse")
def cache_reuse(spark, sf):
    """Opening an index again takes its saved vectors, as its fingerprint is the same."""
    own = units(spark, sf)
    path = new_path(spark, "cache")
    store.open_or_build(search.SearchIndex(own), path)
    again = store.open_or_build(search.SearchIndex(own), path)
    return again.vectors.select("ordinal", F.size("embedding").alias("dim"))
