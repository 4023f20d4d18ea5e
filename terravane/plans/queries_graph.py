"""Queries over graphs and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravane.operators import binning, enrich, graph, pruning, trees
from terravane.plans import fixtures as fx

QUERIES, ORACLES = {}, {}
E = fx.E


def query(sql: str | None):
    def put(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return put


CC = """r(v, l) USING KEY (v) AS (SELECT DISTINCT a, a FROM ee UNION
SELECT ee.b, min(r.l) FROM r JOIN ee ON ee.a = r.v JOIN recurring.r x ON x.v = ee.b WHERE r.l < x.l GROUP BY ee.b)"""


@query(f"WITH {E} SELECT a, b, CAST(w AS DOUBLE) AS w FROM ee")
def graph_adjacency(spark, sf):
    return graph.adjacency(fx.edges(spark, sf), "weight")


@query(f"WITH {E} SELECT a AS vertex_id, count(*) AS degree FROM ee GROUP BY a")
def graph_degree(spark, sf):
    return graph.degrees(fx.edges(spark, sf))


@query(f"WITH {E} SELECT a AS vertex_id, count(DISTINCT b) AS degree FROM ee GROUP BY a")
def graph_degree_simple(spark, sf):
    return graph.degrees(fx.edges(spark, sf), simple=True)


@query(f"WITH RECURSIVE {E}, {CC} SELECT v AS vertex_id, l AS component FROM r")
def graph_components(spark, sf):
    return graph.connected_components(fx.edges(spark, sf))


@query(f"WITH RECURSIVE {E}, {CC} SELECT component, count(*) AS n FROM (SELECT coalesce(l, c_custkey) AS component FROM customer LEFT JOIN r ON v = c_custkey) GROUP BY component")
def graph_component_sizes(spark, sf):
    return graph.sizes(graph.connected_components(fx.edges(spark, sf), fx.customers(spark, sf)))


BFS = """r(v, d) USING KEY (v) AS (SELECT (SELECT min(a) FROM ee), CAST(0 AS BIGINT) UNION
SELECT ee.b, min(r.d) + 1 FROM r JOIN ee ON ee.a = r.v LEFT JOIN recurring.r x ON x.v = ee.b WHERE x.v IS NULL GROUP BY ee.b)"""


def _source(edges) -> int:
    return edges.agg(F.min(F.least("v0", "v1"))).first()[0]


@query(f"WITH RECURSIVE {E}, {BFS} SELECT r.v AS vertex_id, r.d AS distance, coalesce(min(p.v), -1) AS predecessor FROM r LEFT JOIN ee ON ee.b = r.v LEFT JOIN r p ON p.v = ee.a AND p.d = r.d - 1 GROUP BY r.v, r.d")
def graph_bfs(spark, sf):
    e = fx.edges(spark, sf)
    return graph.bfs(e, _source(e))


@query(f"WITH RECURSIVE {E}, {BFS} SELECT d AS distance, count(*) AS n FROM r WHERE d <= 3 GROUP BY d")
def graph_bfs_cutoff(spark, sf):
    e = fx.edges(spark, sf)
    return graph.bfs(e, _source(e), 3).groupBy("distance").agg(F.count(F.lit(1)).alias("n"))


SSSP = """m AS (SELECT a, b, min(w) AS w FROM ee GROUP BY a, b),
r(v, c) USING KEY (v) AS (SELECT (SELECT min(a) FROM ee), CAST(0 AS BIGINT) UNION
SELECT m.b, min(r.c + m.w) FROM r JOIN m ON m.a = r.v LEFT JOIN recurring.r x ON x.v = m.b WHERE x.v IS NULL OR r.c + m.w < x.c GROUP BY m.b)"""


@query(f"WITH RECURSIVE {E}, {SSSP} SELECT v AS vertex_id, CAST(c AS DOUBLE) AS cost FROM r")
def graph_shortest_distances(spark, sf):
    e = fx.edges(spark, sf)
    return graph.shortest_distances(e, _source(e), "weight")


@query(f"""WITH RECURSIVE {E}, {SSSP}, pr AS (SELECT m.b, min(m.a) AS a FROM m JOIN r p ON p.v = m.a JOIN r q ON q.v = m.b WHERE p.c + m.w = q.c GROUP BY m.b),
w(v, k) AS (SELECT (SELECT max(v) FROM r), 0 UNION ALL SELECT pr.a, k + 1 FROM w JOIN pr ON pr.b = w.v WHERE w.v <> (SELECT min(a) FROM ee))
SELECT CAST((SELECT max(k) FROM w) - k AS BIGINT) AS step, w.v AS vertex_id, CAST(r.c AS DOUBLE) AS cost FROM w JOIN r ON r.v = w.v""")
def graph_shortest_path(spark, sf):
    e = fx.edges(spark, sf)
    source = _source(e)
    target = graph.bfs(e, source).agg(F.max("vertex_id")).first()[0]
    return graph.shortest_path(e, source, target, "weight")


@query(f"""WITH RECURSIVE {E}, z AS (SELECT v0 AS a, v1 AS b, weight % 3 AS w FROM e UNION ALL SELECT v1, v0, weight % 3 FROM e), m AS (SELECT a, b, min(w) AS w FROM z GROUP BY a, b),
r(v, c) USING KEY (v) AS (SELECT (SELECT min(a) FROM ee), CAST(0 AS BIGINT) UNION
SELECT m.b, min(r.c + m.w) FROM r JOIN m ON m.a = r.v LEFT JOIN recurring.r x ON x.v = m.b WHERE x.v IS NULL OR r.c + m.w < x.c GROUP BY m.b)
SELECT CAST(c AS DOUBLE) AS cost, true AS whole FROM r WHERE v = (SELECT max(v) FROM r)""")
def graph_shortest_path_zero_weights(spark, sf):
    """Weights of 0, 1 and 2: the cost of the path, and whether its edges add up to it."""
    e = fx.edges(spark, sf).withColumn("weight", F.col("weight") % 3)
    source = _source(e)
    target = graph.bfs(e, source).agg(F.max("vertex_id")).first()[0]
    path = graph.shortest_path(e, source, target, "weight")
    ahead = path.select((F.col("step") - 1).alias("step"), F.col("vertex_id").alias("b"), F.col("cost").alias("after"))
    steps = path.select("step", F.col("vertex_id").alias("a"), "cost").join(ahead, "step")
    least = graph.adjacency(e, "weight").groupBy("a", "b").agg(F.min("w").alias("w"))
    walked = steps.join(least, ["a", "b"]).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("c"))
    whole = path.agg(F.max("step").alias("steps"), F.max("cost").alias("cost")).join(walked, F.col("steps") == F.col("n"), "left")
    return whole.select("cost", F.coalesce(F.col("c") == F.col("cost"), F.lit(False)).alias("whole"))


CORE = """r(v, h) USING KEY (v) AS (SELECT a, count(*) FROM ee GROUP BY a UNION SELECT v, nh FROM (
SELECT n.v, max(least(n.rn, n.h)) AS nh, any_value(n.cur) AS cur FROM (
  SELECT x.v AS v, x.h AS cur, y.h AS h, row_number() OVER (PARTITION BY x.v ORDER BY y.h DESC) AS rn
  FROM recurring.r x JOIN ee ON ee.a = x.v JOIN recurring.r y ON y.v = ee.b) n GROUP BY n.v) z WHERE nh < cur)"""


@query(f"WITH RECURSIVE {E}, {CORE} SELECT v AS vertex_id, h AS core FROM r")
def graph_k_core(spark, sf):
    return graph.k_core(fx.edges(spark, sf))


@query(f"WITH RECURSIVE {E}, {CORE} SELECT h AS core, count(*) AS n FROM r GROUP BY h")
def graph_core_sizes(spark, sf):
    return graph.sizes(graph.k_core(fx.edges(spark, sf)), "core")


LPA = """s AS (SELECT a, b FROM ee),
r(k, v, l) AS (SELECT 0, a, a FROM (SELECT DISTINCT a FROM s) UNION ALL
SELECT k, v, l FROM (SELECT r.k + 1 AS k, s.a AS v, r.l, row_number() OVER (PARTITION BY s.a ORDER BY count(*) DESC, r.l) AS o
  FROM r JOIN s ON s.b = r.v WHERE r.k < 20 GROUP BY r.k, s.a, r.l) WHERE o = 1)"""


@query(f"WITH RECURSIVE {E}, {LPA} SELECT v AS vertex_id, l AS label FROM r WHERE k = 20")
def graph_label_propagation(spark, sf):
    return graph.label_propagation(fx.edges(spark, sf))


@query(f"""WITH {E}, k AS (SELECT a % 20 AS c, sum(w) AS k, sum(CASE WHEN a % 20 = b % 20 THEN w ELSE 0 END) AS i FROM ee GROUP BY 1)
SELECT round(sum(i) / CAST(sum(k) AS DOUBLE) - sum(CAST(k AS DOUBLE) * k) / (CAST(sum(k) AS DOUBLE) * sum(k)), 9) AS q FROM k""")
def graph_modularity(spark, sf):
    e = fx.edges(spark, sf)
    labels = fx.customers(spark, sf).withColumn("label", F.col("vertex_id") % 20)
    return graph.modularity(e, labels, "weight").select(F.round("q", 9).alias("q"))


@query(None)
def graph_louvain(spark, sf):
    """Labels depend on the order of moves; tests hold the communities of known graphs."""
    return graph.louvain(fx.edges(spark, sf))


@query(f"""WITH {E} SELECT least(v0 % 40, v1 % 40) AS v0, greatest(v0 % 40, v1 % 40) AS v1, CAST(sum(weight) AS BIGINT) AS weight FROM e
WHERE v0 % 40 <> v1 % 40 GROUP BY ALL""")
def graph_contract(spark, sf):
    mapping = fx.customers(spark, sf).withColumn("to", F.col("vertex_id") % 40)
    return binning.contract_edges(fx.edges(spark, sf), mapping, "weight")


@query(f"""WITH {E}, c AS (SELECT c_custkey AS k, CAST(floor(c_custkey / 50.0) AS BIGINT) || ',' || CAST(floor(c_nationkey / 10.0) AS BIGINT) || ',0' AS b FROM customer)
SELECT least(p.b, q.b) AS v0, greatest(p.b, q.b) AS v1, CAST(sum(weight) AS BIGINT) AS weight FROM e JOIN c p ON p.k = v0 JOIN c q ON q.k = v1 WHERE p.b <> q.b GROUP BY ALL""")
def graph_coarsen(spark, sf):
    points = fx.table(spark, sf, "customer").selectExpr("c_custkey AS vertex_id", "c_custkey AS x", "c_nationkey AS y", "0 AS z")
    return binning.coarsen_graph(points, fx.edges(spark, sf), (50.0, 10.0, 1.0), "weight")[1]


@query(f"""WITH {E}, s AS (SELECT DISTINCT a, b FROM ee), d AS (SELECT a, count(*) AS k FROM s GROUP BY a),
t AS (SELECT x.a, count(*) AS t FROM s x JOIN s y ON y.a = x.b JOIN s z ON z.a = y.b AND z.b = x.a WHERE x.b < y.b GROUP BY x.a)
SELECT d.a AS vertex_id, coalesce(t, 0) AS triangles, CASE WHEN k > 1 THEN 2.0 * CAST(coalesce(t, 0) AS DOUBLE) / CAST(k * (k - 1) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS coefficient
FROM d LEFT JOIN t USING (a)""")
def graph_clustering(spark, sf):
    return graph.clustering(fx.edges(spark, sf))


@query(f"""WITH RECURSIVE {E}, {CC}, z AS (SELECT count(*) AS n FROM (SELECT coalesce(l, c_custkey) AS c FROM customer LEFT JOIN r ON v = c_custkey) GROUP BY c)
SELECT (SELECT count(*) FROM customer) AS nodes, (SELECT count(*) FROM e) AS edges, 2.0 * (SELECT count(*) FROM e) / CAST((SELECT count(*) FROM customer) AS DOUBLE) AS mean_degree,
count(*) AS n_components, max(n) AS largest FROM z""")
def graph_summary(spark, sf):
    return graph.summary(fx.customers(spark, sf), fx.edges(spark, sf))


@query(f"""WITH RECURSIVE {E}, {CC}, h(v, d) USING KEY (v) AS (SELECT v, CAST(0 AS BIGINT) FROM r WHERE v = l UNION
SELECT ee.b, min(h.d) + 1 FROM h JOIN ee ON ee.a = h.v LEFT JOIN recurring.h x ON x.v = ee.b WHERE x.v IS NULL GROUP BY ee.b)
SELECT h.v AS vertex_id, r.l AS component, h.d AS depth, coalesce(min(p.v), -1) AS parent FROM h JOIN r ON r.v = h.v LEFT JOIN ee ON ee.b = h.v LEFT JOIN h p ON p.v = ee.a AND p.d = h.d - 1 GROUP BY h.v, r.l, h.d""")
def graph_split_components(spark, sf):
    e = fx.edges(spark, sf)
    used = e.select(F.col("v0").alias("vertex_id")).union(e.select("v1")).distinct()
    return graph.split_components(e, used)


def _prune_sql(rounds: int, min_length: float, min_vertices: int) -> str:
    """Rounds of pruning one after the other; those after the last with a short branch change nothing."""
    parts = ["g0 AS MATERIALIZED (SELECT vertex_id AS a, parent AS b FROM t WHERE parent >= 0 UNION SELECT parent, vertex_id FROM t WHERE parent >= 0)"]
    far = "sqrt((p.x - q.x) ** 2.0 + (p.y - q.y) ** 2.0 + (p.z - q.z) ** 2.0)"
    for r in range(rounds):
        parts += [
            f"h{r} AS MATERIALIZED (SELECT g.a, g.b, k, {far} AS l FROM g{r} g JOIN (SELECT a, count(*) AS k FROM g{r} GROUP BY a) d USING (a) JOIN t p ON p.vertex_id = g.a JOIN t q ON q.vertex_id = g.b)",
            f"w{r}(leaf, came, v, n, l) AS (SELECT a, a, b, 1, l FROM h{r} WHERE k = 1 UNION ALL SELECT leaf, w.v, h.b, n + 1, w.l + h.l FROM w{r} w JOIN h{r} h ON h.a = w.v AND h.k = 2 AND h.b <> w.came)",
            f"s{r} AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY leaf) AS place FROM (SELECT DISTINCT leaf, w.v, n, w.l, h.k FROM w{r} w JOIN h{r} h ON h.a = w.v WHERE h.k <> 2) WHERE l < {min_length} OR n < {min_vertices})",
            f"z{r} AS MATERIALIZED (SELECT leaf FROM s{r} WHERE k = 1 OR place <= k - 2)",
            f"x{r} AS MATERIALIZED (SELECT DISTINCT came AS v FROM w{r} WHERE leaf IN (SELECT leaf FROM z{r}))",
            f"g{r + 1} AS MATERIALIZED (SELECT a, b FROM g{r} WHERE a NOT IN (SELECT v FROM x{r}) AND b NOT IN (SELECT v FROM x{r}))",
        ]
    gone = " UNION ALL ".join(f"SELECT v FROM x{r}" for r in range(rounds))
    count = " + ".join(f"(SELECT count(*) FROM z{r})" for r in range(rounds))
    parts.append(f"m AS (SELECT vertex_id, row_number() OVER (ORDER BY vertex_id) - 1 AS n FROM t WHERE vertex_id NOT IN ({gone}))")
    return f"""WITH RECURSIVE {fx.T}, {", ".join(parts)}
SELECT t.vertex_id AS v0, t.parent AS v1, p.n AS n0, q.n AS n1, CAST({count} AS BIGINT) AS removed FROM t JOIN m p ON p.vertex_id = t.vertex_id JOIN m q ON q.vertex_id = t.parent"""


@query(_prune_sql(12, 8.0, 3))
def graph_prune(spark, sf):
    """Branches of the parts' tree that are shorter than 8 or have fewer than 3 vertices."""
    tree = fx.tree(spark, sf)
    got = pruning.prune(tree, tree.where("parent >= 0").selectExpr("vertex_id AS v0", "parent AS v1"), 8.0, 3)
    return got.edges.select("v0", "v1", "n0", "n1", F.lit(got.removed).cast("long").alias("removed"))


@query(f"""WITH {E}, k AS (SELECT c_custkey AS v FROM customer WHERE c_custkey BETWEEN 20 AND 900 AND c_nationkey BETWEEN 3 AND 20)
SELECT edge_id, v0, v1, weight FROM e WHERE v0 IN (SELECT v FROM k) AND v1 IN (SELECT v FROM k)""")
def graph_filter_bbox(spark, sf):
    points = fx.table(spark, sf, "customer").selectExpr("c_custkey AS vertex_id", "c_custkey AS x", "c_nationkey AS y", "0 AS z")
    return graph.within_bbox(points, fx.edges(spark, sf), (20, 3, 0), (900, 20, 0))[1].select("edge_id", "v0", "v1", "weight")


@query(f"""WITH RECURSIVE {E}, {CC}, s AS (SELECT DISTINCT a, b FROM ee), d AS (SELECT a, count(*) AS k FROM s GROUP BY a),
t AS (SELECT x.a, count(*) AS t FROM s x JOIN s y ON y.a = x.b JOIN s z ON z.a = y.b AND z.b = x.a WHERE x.b < y.b GROUP BY x.a)
SELECT c_custkey AS vertex_id, coalesce(k, 0) AS degree, coalesce(l, c_custkey) AS component, CASE WHEN k > 1 THEN 2.0 * CAST(coalesce(t, 0) AS DOUBLE) / CAST(k * (k - 1) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS clustering
FROM customer LEFT JOIN d ON d.a = c_custkey LEFT JOIN t ON t.a = c_custkey LEFT JOIN r ON v = c_custkey""")
def graph_enriched(spark, sf):
    """Customers with the columns that a graph's ingest adds."""
    return enrich.network(fx.customers(spark, sf), fx.edges(spark, sf))


# -- trees -----------------------------------------------------------------------

DEPTH = "dd(v, d) AS (SELECT vertex_id, CAST(0 AS BIGINT) FROM t WHERE parent < 0 UNION ALL SELECT t.vertex_id, d + 1 FROM dd JOIN t ON t.parent = dd.v)"
KIND = """c AS (SELECT t.vertex_id, t.parent, count(k.vertex_id) AS children FROM t LEFT JOIN t k ON k.parent = t.vertex_id GROUP BY t.vertex_id, t.parent),
kd AS (SELECT *, CASE WHEN parent < 0 THEN 0 WHEN children >= 2 THEN 1 WHEN children = 1 THEN 2 ELSE 3 END AS kind FROM c)"""
FAR = "a(v, anchor, hops) AS (SELECT vertex_id, vertex_id, CAST(0 AS BIGINT) FROM kd WHERE kind <> 2 UNION ALL SELECT kd.vertex_id, a.anchor, a.hops + 1 FROM a JOIN kd ON kd.parent = a.v AND kd.kind = 2)"


@query(f"WITH RECURSIVE {fx.T}, {DEPTH} SELECT v AS vertex_id, d AS depth FROM dd")
def tree_depth(spark, sf):
    return trees.depths(fx.tree(spark, sf))


@query(f"""WITH RECURSIVE {fx.T}, {DEPTH}, {KIND}, mx AS (SELECT max(d) AS m FROM dd),
st(lev, v, parent, s) AS (SELECT CAST((SELECT m FROM mx) AS BIGINT), kd.vertex_id, kd.parent, CAST(1 AS BIGINT) FROM kd JOIN dd ON dd.v = kd.vertex_id WHERE d = (SELECT m FROM mx)
UNION ALL SELECT * FROM (SELECT g.lev - 1 AS lev, kd.vertex_id, kd.parent,
  CASE WHEN kd.kind = 3 OR kd.children = 0 THEN CAST(1 AS BIGINT) ELSE x.s END AS s
  FROM (SELECT DISTINCT lev FROM st WHERE lev > 0) g JOIN dd ON dd.d = g.lev - 1 JOIN kd ON kd.vertex_id = dd.v
  LEFT JOIN (SELECT parent, max(s) + CASE WHEN count(*) FILTER (s = mm) >= 2 THEN 1 ELSE 0 END AS s FROM (SELECT parent, s, max(s) OVER (PARTITION BY parent) AS mm FROM st) GROUP BY parent) x
  ON x.parent = kd.vertex_id) q)
SELECT v AS vertex_id, s AS strahler FROM st""")
def tree_strahler(spark, sf):
    return trees.strahler(fx.tree(spark, sf))


@query(f"WITH {fx.T}, {KIND} SELECT vertex_id, CAST(kind AS BIGINT) AS kind FROM kd")
def tree_node_kind(spark, sf):
    return trees.kinds(fx.tree(spark, sf))


@query(f"WITH {fx.T}, {KIND} SELECT vertex_id, children FROM kd")
def tree_child_counts(spark, sf):
    return trees.child_counts(fx.tree(spark, sf))


@query(f"WITH RECURSIVE {fx.T}, {KIND}, {FAR} SELECT v AS vertex_id, anchor, hops FROM a")
def tree_anchor_distance(spark, sf):
    return trees.anchor_distance(fx.tree(spark, sf))


@query(f"WITH RECURSIVE {fx.T}, {KIND}, {FAR} SELECT v AS vertex_id FROM a WHERE hops % 2 = 0 UNION SELECT vertex_id FROM t WHERE vertex_id % 11 = 5")
def tree_decimate(spark, sf):
    tree = fx.tree(spark, sf)
    return trees.decimated(tree, 2, tree.where("vertex_id % 11 = 5"))


@query(f"""WITH RECURSIVE {fx.T}, k AS (SELECT vertex_id FROM t WHERE parent < 0 OR vertex_id % 3 = 0),
o(v, owner) AS (SELECT vertex_id, vertex_id FROM k UNION ALL SELECT t.vertex_id, o.owner FROM o JOIN t ON t.parent = o.v WHERE t.vertex_id NOT IN (SELECT vertex_id FROM k)),
g AS (SELECT owner, max(radius) AS radius FROM o JOIN t ON t.vertex_id = o.v GROUP BY owner)
SELECT k.vertex_id, coalesce(po.owner, -1) AS parent, g.radius FROM k JOIN t USING (vertex_id) LEFT JOIN o po ON po.v = t.parent LEFT JOIN g ON g.owner = k.vertex_id""")
def tree_collapse(spark, sf):
    tree = fx.tree(spark, sf)
    return trees.collapse(tree, tree.where("parent < 0 OR vertex_id % 3 = 0"), {"radius": "max"}, tree.select("vertex_id", "radius"))


@query(f"WITH {fx.T} SELECT vertex_id AS edge_id, vertex_id AS child, parent FROM t WHERE parent >= 0")
def tree_edges(spark, sf):
    made = trees.rooted(fx.tree(spark, sf).where("parent >= 0").selectExpr("vertex_id AS edge_id", "vertex_id AS child", "parent"))
    return made.where("parent >= 0").selectExpr("vertex_id AS edge_id", "vertex_id AS child", "parent")


@query(None)
def tree_simplify(spark, sf):
    """Chains between anchors simplified by distance; tests hold known trees."""
    tree = fx.tree(spark, sf)
    return trees.simplify(tree, tree, 2.0)
