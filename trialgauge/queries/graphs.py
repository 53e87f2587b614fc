"""G: knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..plans import clinical_views as cv
from ..plans.staging import kept
from .book import Book
from .sqlkit import define

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

_P = "CAST(NULL AS VARCHAR)"


def _node(src_ord, view, where, node_id, node_type, label):
    """``id, node_type, o, row_ord, label``: label stands for the stored properties."""
    return f"SELECT {node_id} AS id, '{node_type}' AS node_type, {src_ord} AS o, row_ord, {label} AS label FROM {view} WHERE {where}"


def _edge(src_ord, view, where, src, dst, edge_type):
    return f"SELECT {src} AS src, {dst} AS dst, '{edge_type}' AS edge_type, {src_ord} AS o, row_ord FROM {view} WHERE {where}"


def _people(o, view, study, subject, site=None, country=None, label=_P):
    nodes = [_node(o, view, "TRUE", f"'STUDY:' || {study}", "Study", _P), _node(o, view, "TRUE", f"'SUBJECT:' || {subject}", "Subject", label)]
    edges = [_edge(o, view, "TRUE", f"'SUBJECT:' || {subject}", f"'STUDY:' || {study}", "ENROLLED_IN")]
    if site:
        nodes += [_node(o, view, "TRUE", f"'COUNTRY:' || {country}", "Country", _P), _node(o, view, "TRUE", f"'SITE:' || {site}", "Site", _P)]
        edges += [
            _edge(o, view, "TRUE", f"'STUDY:' || {study}", f"'SITE:' || {site}", "CONDUCTED_AT"),
            _edge(o, view, "TRUE", f"'SUBJECT:' || {subject}", f"'SITE:' || {site}", "ENROLLED_AT"),
            _edge(o, view, "TRUE", f"'SITE:' || {site}", f"'COUNTRY:' || {country}", "LOCATED_IN"),
        ]
    return nodes, edges


def _sources():
    out = [_people(0, "v_edrr", "study", "subject", label="CAST(total_open_issue_count_per_subject AS VARCHAR)")]
    n, e = _people(1, "v_esae", "study_id", "patient_id", "site", "country")
    n.append(_node(1, "v_esae", "TRUE", "'DISCREPANCY:' || discrepancy_id", "SafetyDiscrepancy", "review_status"))
    e.append(_edge(1, "v_esae", "TRUE", "'SUBJECT:' || patient_id", "'DISCREPANCY:' || discrepancy_id", "HAS_DISCREPANCY"))
    out.append((n, e))
    for o, view, prefix, kind, etype in ((2, "v_meddra", "MEDDRA", "MedDRACoding", "HAS_AE_CODING"), (3, "v_whodd", "WHODD", "WHODDCoding", "HAS_DRUG_CODING")):
        n, e = _people(o, view, "study", "subject")
        c = f"concat_ws(':', '{prefix}', study, subject, form_oid, logline)"
        n.append(_node(o, view, "TRUE", c, kind, "coding_status"))
        e.append(_edge(o, view, "TRUE", "'SUBJECT:' || subject", c, etype))
        out.append((n, e))
    n, e = _people(4, "v_pages", "study_name", "subjectname", "sitenumber", "country")
    v = "concat_ws(':', 'VISIT', study_name, subjectname, foldername)"
    f = "concat_ws(':', 'FORM', study_name, formname)"
    m = "concat_ws(':', 'MISSING', study_name, subjectname, foldername, formname)"
    n += [
        _node(4, "v_pages", "TRUE", v, "Visit", _P),
        _node(4, "v_pages", "TRUE", f, "Form", _P),
        _node(4, "v_pages", "days_missing > 0", m, "MissingPage", "CAST(days_missing AS VARCHAR)"),
    ]
    e += [
        _edge(4, "v_pages", "TRUE", "'SUBJECT:' || subjectname", v, "HAS_VISIT"),
        _edge(4, "v_pages", "TRUE", v, f, "COMPLETED_FORM"),
        _edge(4, "v_pages", "days_missing > 0", f, m, "MISSING_PAGE_FOR"),
    ]
    out.append((n, e))
    n, e = _people(5, "v_visit", "study", "subject", "site", "country")
    v = "concat_ws(':', 'VISIT', study, subject, visit)"
    n.append(_node(5, "v_visit", "TRUE", v, "Visit", "CAST(days_outstanding AS VARCHAR)"))
    e.append(_edge(5, "v_visit", "TRUE", "'SUBJECT:' || subject", v, "HAS_VISIT"))
    out.append((n, e))
    return out


define("q_all_nodes", " UNION ALL ".join(x for n, _ in _sources() for x in n))
define("q_all_edges", " UNION ALL ".join(x for _, e in _sources() for x in e))
define(
    "q_nodes",
    "SELECT id, node_type, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o, row_ord) AS rn FROM q_all_nodes) q WHERE rn = 1",
)
define(
    "q_edges",
    "SELECT src, dst, edge_type FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY o, row_ord, edge_type) AS rn FROM q_all_edges) q WHERE rn = 1",
)
define("q_both", "SELECT src AS node, dst AS neighbour, edge_type FROM q_edges UNION ALL SELECT dst, src, edge_type FROM q_edges")
define("q_issue_of", "SELECT id, coalesce(TRY_CAST(label AS BIGINT), 0) AS issues FROM q_nodes WHERE node_type = 'Subject'")


def _graph(spark, sf_dir):
    """The whole graph, materialised once per input."""
    return kept(spark, "graph", cv.source_paths(sf_dir), lambda: g.build_from_views(spark, sf_dir))


def _links(spark, sf_dir):
    """The graph's adjacency in buckets, stored once per input."""
    return kept(spark, "adjacency", cv.source_paths(sf_dir), lambda: g.adjacency(_graph(spark, sf_dir)[1]))


_STATS = (
    "SELECT 'node' AS kind, node_type AS type, count(*) AS n FROM {n} GROUP BY 2 UNION ALL SELECT 'edge', edge_type, count(*) FROM {e} GROUP BY 2"
)


@book.add("g01_first_node_wins", "SELECT id, node_type, CASE WHEN node_type = 'Subject' THEN coalesce(TRY_CAST(label AS BIGINT), 0) END AS issues FROM q_nodes")
def g01(spark, sf_dir):
    nodes, _ = _graph(spark, sf_dir)
    issues = F.coalesce(g.prop("open_issue_count").try_cast("long"), F.lit(0).cast("long"))
    return nodes.select("id", "node_type", F.when(F.col("node_type") == "Subject", issues).alias("issues"))


@book.add("g02_first_edge_wins", "SELECT src, dst, edge_type FROM q_edges")
def g02(spark, sf_dir):
    return _graph(spark, sf_dir)[1].select("src", "dst", "edge_type")


def _part_query(name: str, part: str, index: int):
    n, e = _sources()[index]
    local = {
        "q_pn": "SELECT DISTINCT id, node_type FROM (" + " UNION ALL ".join(n) + ") q",
        "q_pe": "SELECT src, dst, min(edge_type) AS edge_type FROM (" + " UNION ALL ".join(e) + ") q GROUP BY src, dst",
    }

    @book.add(name, _STATS.format(n="q_pn", e="q_pe"), **local)
    def query(spark, sf_dir):
        builders = {
            "issues": lambda: g.from_issues(cv.issues(spark, sf_dir)),
            "safety": lambda: g.from_safety(cv.safety(spark, sf_dir)),
            "meddra": lambda: g.from_meddra(cv.meddra(spark, sf_dir)),
            "whodd": lambda: g.from_whodd(cv.whodd(spark, sf_dir)),
            "pages": lambda: g.from_missing_pages(cv.missing_pages(spark, sf_dir)),
            "visits": lambda: g.from_visits(cv.visits(spark, sf_dir)),
        }
        return g.statistics(*g.build([builders[part]()]))

    return query


for _i, (_n, _p) in enumerate(
    [
        ("g03_from_issues", "issues"), ("g04_from_safety", "safety"), ("g05_from_meddra", "meddra"),
        ("g06_from_whodd", "whodd"), ("g07_from_missing_pages", "pages"), ("g08_from_visit_projection", "visits"),
    ]
):
    _part_query(_n, _p, _i)


@book.add(
    "g09_enrich_studies",
    "SELECT n.id, CAST(m.total_issues AS DOUBLE) AS total_issues, CAST(m.max_issues AS DOUBLE) AS max_issues, m.meddra_records, m.esae_records "
    "FROM q_nodes n JOIN q_study_metrics m ON n.id = 'STUDY:' || m.study",
)
def g09(spark, sf_dir):
    nodes, _ = _graph(spark, sf_dir)
    names = ["total_issues", "max_issues", "meddra_records", "esae_records"]
    return g.by_type(nodes, "Study").select("id", *[g.prop(n).try_cast("double").alias(n) for n in names])


@book.add("g10_build_statistics", _STATS.format(n="q_nodes", e="q_edges"))
def g10(spark, sf_dir):
    return g.statistics(*g.build_from_views(spark, sf_dir))


@book.add("g11_nodes_by_type", "SELECT id, label AS review_status FROM q_nodes WHERE node_type = 'SafetyDiscrepancy'")
def g11(spark, sf_dir):
    nodes, _ = _graph(spark, sf_dir)
    return g.by_type(nodes, "SafetyDiscrepancy").select("id", g.prop("review_status").alias("review_status"))


@book.add(
    "g12_neighbours",
    "SELECT dst AS id, edge_type, 'out' AS direction, node_type FROM q_edges JOIN q_nodes ON dst = id WHERE src = 'SITE:Site 1' "
    "UNION ALL SELECT src, edge_type, 'in', node_type FROM q_edges JOIN q_nodes ON src = id WHERE dst = 'SITE:Site 1'",
)
def g12(spark, sf_dir):
    return g.neighbours(*_graph(spark, sf_dir), "SITE:Site 1")


@book.add(
    "g13_related_of_type",
    "SELECT node, count(DISTINCT neighbour) AS subjects FROM q_both JOIN q_nodes a ON node = a.id AND a.node_type = 'Site' "
    "JOIN q_nodes b ON neighbour = b.id AND b.node_type = 'Subject' GROUP BY node",
)
def g13(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    start = g.by_type(nodes, "Site").select(F.col("id").alias("node"))
    pairs = g.related_of_type(start, nodes, edges, "Subject")
    return pairs.groupBy("node").agg(F.count(F.lit(1)).alias("subjects"))


@book.add("g14_out_neighbours", "SELECT dst, edge_type FROM q_edges WHERE src = 'STUDY:Study 1' ORDER BY dst LIMIT 50")
def g14(spark, sf_dir):
    return g.out_neighbours(_graph(spark, sf_dir)[1], "STUDY:Study 1", 50)


@book.add(
    "g15_study_info",
    "SELECT study AS study_id, CAST(total_issues AS DOUBLE) AS total_issues FROM q_study_metrics",
)
def g15(spark, sf_dir):
    return g.study_info(_graph(spark, sf_dir)[0])


@book.add(
    "g16_subjects_with_issues",
    "SELECT replace(id, 'SUBJECT:', '') AS subject_id, issues FROM q_issue_of WHERE issues >= 2 ORDER BY issues DESC, subject_id LIMIT 20",
)
def g16(spark, sf_dir):
    return g.subjects_with_issues(_graph(spark, sf_dir)[0], 2, 20)


define("q_pending", "SELECT id FROM q_nodes WHERE node_type = 'SafetyDiscrepancy' AND contains(lower(label), 'pending')")


@book.add(
    "g17_safety_reviews",
    "SELECT replace(id, 'DISCREPANCY:', '') AS discrepancy_id, replace(min(src), 'SUBJECT:', '') AS subject_id FROM q_pending "
    "JOIN q_edges ON dst = id AND edge_type = 'HAS_DISCREPANCY' GROUP BY id",
)
def g17(spark, sf_dir):
    return g.safety_reviews(*_graph(spark, sf_dir), "Pending")


@book.add(
    "g18_safety_reviews_by_site",
    "SELECT replace(b.dst, 'SITE:', '') AS site_id, count(*) AS reviews FROM q_pending JOIN q_edges a ON a.dst = id AND a.edge_type = 'HAS_DISCREPANCY' "
    "JOIN q_edges b ON b.src = a.src AND b.edge_type = 'ENROLLED_AT' GROUP BY 1",
)
def g18(spark, sf_dir):
    return g.safety_reviews_by_site(*_graph(spark, sf_dir), "Pending")


@book.add(
    "g19_aged_missing_pages",
    "SELECT id, CAST(label AS DOUBLE) AS days FROM q_nodes WHERE node_type = 'MissingPage' AND CAST(label AS DOUBLE) >= 30",
)
def g19(spark, sf_dir):
    return g.aged_missing_pages(_graph(spark, sf_dir)[0], 30)


@book.add(
    "g20_site_risk_summary",
    "SELECT replace(dst, 'SITE:', '') AS site_id, CAST(sum(issues) AS BIGINT) AS issues, count(*) AS subjects FROM q_edges JOIN q_issue_of ON src = id "
    "WHERE edge_type = 'ENROLLED_AT' GROUP BY 1",
)
def g20(spark, sf_dir):
    return g.site_risk_summary(*_graph(spark, sf_dir))


_HOPS = {
    "q_hop0": "SELECT id, id AS target FROM q_nodes WHERE node_type = '{t}'",
    "q_hop1": "SELECT neighbour AS id, min(target) AS target FROM q_both JOIN q_hop0 ON node = q_hop0.id WHERE neighbour NOT IN (SELECT id FROM q_hop0) GROUP BY 1",
    "q_hop2": "SELECT neighbour AS id, min(target) AS target FROM q_both JOIN q_hop1 ON node = q_hop1.id WHERE neighbour NOT IN (SELECT id FROM q_hop0 UNION ALL SELECT id FROM q_hop1) GROUP BY 1",
    "q_hop3": "SELECT neighbour AS id, min(target) AS target FROM q_both JOIN q_hop2 ON node = q_hop2.id WHERE neighbour NOT IN (SELECT id FROM q_hop0 UNION ALL SELECT id FROM q_hop1 UNION ALL SELECT id FROM q_hop2) GROUP BY 1",
    "q_near": "SELECT * FROM q_hop0 UNION ALL SELECT * FROM q_hop1 UNION ALL SELECT * FROM q_hop2 UNION ALL SELECT * FROM q_hop3",
}


@book.add(
    "g21_count_by_nearest_target",
    "SELECT replace(target, 'COUNTRY:', '') AS name, count(*) AS n FROM q_pending JOIN q_near USING (id) GROUP BY 1 ORDER BY n DESC, name LIMIT 10",
    **{k: v.format(t="Country") for k, v in _HOPS.items()},
)
def g21(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return g.count_by_target(nodes, edges, "SafetyDiscrepancy", "Country", "review_status", "Pending", 10, _links(spark, sf_dir))


@book.add(
    "g21_count_by_direct_target",
    "SELECT replace(target, 'SITE:', '') AS name, count(*) AS n FROM q_nodes JOIN q_near USING (id) WHERE node_type = 'Subject' GROUP BY 1 ORDER BY n DESC, name LIMIT 10",
    **{k: v.format(t="Site") for k, v in _HOPS.items()},
)
def g21_direct(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return g.count_by_target(nodes, edges, "Subject", "Site", limit=10, links=_links(spark, sf_dir))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({t}), '[^a-zA-Z0-9]'), lambda w: w <> ''))"
define("q_words", f"SELECT id, node_type, unnest({_WORDS.format(t='id || chr(32) || node_type')}) AS word FROM q_nodes")


@book.add("g22_keyword_index", "SELECT word, count(*) AS nodes FROM q_words GROUP BY word")
def g22(spark, sf_dir):
    return g.keyword_index(_graph(spark, sf_dir)[0]).groupBy("word").agg(F.count(F.lit(1)).alias("nodes"))


_QUERY = "pending visit of subject 12 at site 7"
_QW = "(" + ", ".join(f"'{w}'" for w in g.query_words(_QUERY)) + ")"
_QN = float(len(g.query_words(_QUERY)))
define(
    "q_start",
    f"SELECT id, node_type, count(*) / {_QN}::DOUBLE AS score FROM q_words WHERE word IN {_QW} GROUP BY id, node_type ORDER BY score DESC, id LIMIT 15",
)


@book.add("g23_keyword_retrieval", "SELECT id, node_type, round(score, 6) AS score FROM q_start")
def g23(spark, sf_dir):
    hits = g.keyword_retrieve(g.keyword_index(_graph(spark, sf_dir)[0]), _QUERY)
    return hits.withColumn("score", F.round("score", 6))


_BOOST = "CASE node_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in g.TYPE_BOOST.items()) + " ELSE 0.0::DOUBLE END"
define(
    "q_heur",
    f"SELECT id, node_type, hits / ({_QN}::DOUBLE + c - hits + 1e-6::DOUBLE) + {_BOOST} AS score FROM "
    f"(SELECT id, node_type, count(*) AS c, count(*) FILTER (WHERE word IN {_QW}) AS hits FROM q_words GROUP BY id, node_type) q",
)


@book.add("g24_heuristic_relevance", "SELECT id, round(score, 6) AS score FROM q_heur")
def g24(spark, sf_dir):
    nodes, _ = _graph(spark, sf_dir)
    return g.heuristic_scores(g.described(nodes), _QUERY).select("id", F.round("score", 6).alias("score"))


def _layer(prev: str, seen: str) -> str:
    return (
        f"SELECT h.id, h.node_type, h.score FROM (SELECT DISTINCT neighbour FROM q_both WHERE node IN (SELECT id FROM {prev}) "
        f"AND neighbour NOT IN ({seen})) c JOIN q_heur h ON c.neighbour = h.id ORDER BY round(h.score, 12) DESC, h.id LIMIT 20"
    )


define("q_layer1", _layer("q_start", "SELECT id FROM q_start"))
define("q_layer2", _layer("q_layer1", "SELECT id FROM q_start UNION ALL SELECT id FROM q_layer1"))
define("q_layer3", _layer("q_layer2", "SELECT id FROM q_start UNION ALL SELECT id FROM q_layer1 UNION ALL SELECT id FROM q_layer2"))
define(
    "q_visited",
    "SELECT id, node_type, 0 AS hop, score AS similarity, 0 AS visit_count FROM q_start UNION ALL SELECT id, node_type, 1, 1.0, 1 FROM q_layer1 "
    "UNION ALL SELECT id, node_type, 2, 1.0, 1 FROM q_layer2 UNION ALL SELECT id, node_type, 3, 1.0, 1 FROM q_layer3",
)


def _visited(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    start = g.keyword_retrieve(g.keyword_index(nodes), _QUERY)
    return g.beam_expand(nodes, edges, _QUERY, start)


@book.add("g25_beam_expansion", "SELECT id, node_type, hop, round(similarity, 6) AS similarity FROM q_visited")
def g25(spark, sf_dir):
    return _visited(spark, sf_dir).select("id", "node_type", "hop", F.round("similarity", 6).alias("similarity"))


_QUESTIONS = {
    "q_ask": "SELECT s_suppkey AS qid, " + _WORDS.format(t="('pending visit of subject ' || (7 * s_suppkey) || ' at site ' || s_suppkey)") + " AS ws FROM supplier",
    "q_askw": "SELECT qid, len(ws)::DOUBLE AS n, unnest(ws) AS word FROM q_ask",
    "q_met": "SELECT qid, n, id, node_type, count(*) AS hits FROM q_words JOIN q_askw USING (word) GROUP BY ALL",
    "q_many0": "SELECT qid, id, node_type, score FROM (SELECT qid, id, node_type, hits / n AS score, row_number() OVER (PARTITION BY qid ORDER BY hits / n DESC, id) AS rn FROM q_met) x WHERE rn <= 15",
    "q_size": "SELECT id, node_type, count(*) AS c FROM q_words GROUP BY ALL",
    **{
        f"q_many{h}": f"SELECT qid, id, node_type, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, id) AS rn FROM (SELECT s.qid, s.id, z.node_type, "
        f"coalesce(m.hits, 0) / (len(a.ws)::DOUBLE + z.c - coalesce(m.hits, 0) + 1e-6::DOUBLE) + {_BOOST.replace('node_type', 'z.node_type', 1)} AS score FROM "
        f"(SELECT DISTINCT p.qid, b.neighbour AS id FROM q_many{h - 1} p JOIN q_both b ON b.node = p.id) s JOIN q_size z ON z.id = s.id JOIN q_ask a ON a.qid = s.qid "
        f"LEFT JOIN q_met m ON m.qid = s.qid AND m.id = s.id WHERE "
        + " AND ".join(f"NOT EXISTS (SELECT 1 FROM q_many{o} v WHERE v.qid = s.qid AND v.id = s.id)" for o in range(h)) + ") x) y WHERE rn <= 20"
        for h in range(1, 4)
    },
    "q_seen": "SELECT qid, id, node_type, 0 AS hop, score AS similarity, 0 AS visits FROM q_many0 "
    + " ".join(f"UNION ALL SELECT qid, id, node_type, {h}, 1.0, 1 FROM q_many{h}" for h in range(1, 4)),
    "q_help": "SELECT *, 0.5 * similarity + 0.5 * visits / greatest(1, max(visits) OVER (PARTITION BY qid)) AS h FROM q_seen",
}


@book.add(
    "g25_questions_at_once",
    "SELECT qid, id, node_type, hop, round(similarity, 6) AS similarity, round(h, 6) AS helpfulness, h >= 0.2 AND row_number() OVER (PARTITION BY qid ORDER BY h DESC, id) <= 15 AS kept FROM q_help",
    **_QUESTIONS,
)
def g25_many(spark, sf_dir):
    """One question per site, all retrieved, expanded and pruned together."""
    nodes, _ = _graph(spark, sf_dir)
    key = F.col("s_suppkey")
    text = F.concat(F.lit("pending visit of subject "), (7 * key).cast("string"), F.lit(" at site "), key.cast("string"))
    asked = cv.table(spark, sf_dir, "supplier").select(key.alias("qid"), text.alias("text"))
    start = g.retrieve_many(g.keyword_index(nodes), asked)
    seen = g.helpful_many(g.expand_many(nodes, _links(spark, sf_dir), asked, start))
    return seen.select("qid", "id", "node_type", "hop", *[F.round(c, 6).alias(c) for c in ("similarity", "helpfulness")], "kept")


_HELP = "0.5 * similarity + 0.5 * visit_count / greatest(1, (SELECT max(visit_count) FROM q_visited))"


@book.add("g26_helpfulness", f"SELECT id, round({_HELP}, 6) AS helpfulness FROM q_visited")
def g26(spark, sf_dir):
    return g.helpfulness(_visited(spark, sf_dir)).select("id", F.round("helpfulness", 6).alias("helpfulness"))


@book.add(
    "g27_prune",
    f"SELECT id, node_type, round(h, 6) AS helpfulness FROM (SELECT *, {_HELP} AS h FROM q_visited) q WHERE h >= 0.2 ORDER BY h DESC, id LIMIT 15",
)
def g27(spark, sf_dir):
    kept = g.prune(g.helpfulness(_visited(spark, sf_dir)))
    return kept.select("id", "node_type", F.round("helpfulness", 6).alias("helpfulness"))


@book.add(
    "g28_results_by_type",
    "SELECT node_type, max(n) AS n, string_agg(id, ',' ORDER BY rn) AS first_ids FROM (SELECT *, row_number() OVER (PARTITION BY node_type ORDER BY id) AS rn, "
    "count(*) OVER (PARTITION BY node_type) AS n FROM q_nodes) q WHERE rn <= 10 GROUP BY node_type",
)
def g28(spark, sf_dir):
    out = g.results_by_type(_graph(spark, sf_dir)[0])
    return out.select("node_type", "n", F.concat_ws(",", "first_ids").alias("first_ids"))


@book.add("g29_entity_properties", "SELECT id, node_type, issues AS open_issue_count FROM q_nodes JOIN q_issue_of USING (id) WHERE id = 'SUBJECT:Subject 5'")
def g29(spark, sf_dir):
    rows = g.entity_properties(_graph(spark, sf_dir)[0], "patient", "Subject 5")
    count = F.coalesce(g.prop("open_issue_count").try_cast("long"), F.lit(0).cast("long"))
    return rows.select("id", "node_type", count.alias("open_issue_count"))
