"""SQL (DuckDB's dialect) that gives the same rows as the queries."""

from __future__ import annotations

from fathom.operators.bloom import PRIME, factors


def _tokens(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}_-]+'), lambda x: regexp_full_match(x, '[a-z_0-9-]+'))"


_STEPS = {
    "d": f"SELECT doc_id + 1 AS docid, {_tokens('text')} AS terms FROM documents",
    "tok": "SELECT docid, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM d",
    "dl": "SELECT docid, CAST(len(terms) AS BIGINT) AS doc_len FROM d",
    "st": "SELECT count(*) AS n_docs, CAST(coalesce(sum(doc_len), 0) AS BIGINT) AS total_len, CAST(sum(doc_len) AS DOUBLE) / count(*) AS avgdl, count(*) // 100 AS default_df,"
    " 2 * (count(*) // 100) AS default_cf, ln((count(*) - count(*) // 100 + 0.5e0) / (count(*) // 100 + 0.5e0)) AS default_idf FROM dl",
    "tf": "SELECT term, docid, count(*) AS tf FROM tok GROUP BY term, docid",
    "ts": "SELECT term, df, cf, ln((n_docs - df + 0.5e0) / (df + 0.5e0)) AS idf FROM (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term), st",
    "b": f"SELECT item_id AS qid, {_tokens('text')} AS terms FROM benchmark",
    "lq": "SELECT qid, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM b",
    "q": "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY pos) AS ord, term, df, cf, idf FROM lq JOIN ts USING (term) WHERE df > 9 AND pos <= 4",
    "lqr": "SELECT qid, term, idf FROM lq JOIN ts USING (term) WHERE df > 9",
    "svs": "SELECT qid, docid FROM (SELECT DISTINCT qid, term FROM q) JOIN tf USING (term) GROUP BY qid, docid"
    " HAVING count(*) = (SELECT count(DISTINCT term) FROM q AS o WHERE o.qid = any_value(qid))",
    "nq": "SELECT qid, count(DISTINCT term) AS n FROM q GROUP BY qid",
    "sv": "SELECT qid, docid FROM (SELECT qid, docid, count(*) AS seen FROM (SELECT DISTINCT qid, term FROM q) JOIN tf USING (term) GROUP BY qid, docid) JOIN nq USING (qid) WHERE seen = n",
    "w": "SELECT qid, docid, round(sum(1.5e0 * tf / (0.5e0 * (0.7e0 + 0.3e0 * doc_len / avgdl) + tf) * idf), 4) AS score FROM q JOIN tf USING (term) JOIN dl USING (docid), st GROUP BY qid, docid",
    "c": "SELECT qid, docid FROM w QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) <= 100",
    "rare": "SELECT qid, term, df FROM q QUALIFY row_number() OVER (PARTITION BY qid ORDER BY df, ord) = 1",
}
del _STEPS["svs"]

_NEEDS = {
    "d": [], "tok": ["d"], "dl": ["d"], "st": ["dl"], "tf": ["tok"], "ts": ["tf", "st"], "b": [], "lq": ["b"], "q": ["lq", "ts"], "lqr": ["lq", "ts"],
    "nq": ["q"], "sv": ["q", "tf", "nq"], "w": ["q", "tf", "dl", "st"], "c": ["w"], "rare": ["q"],
}


def _with(body: str, *steps: str, more: dict[str, str] | None = None) -> str:
    needed: dict[str, None] = {}

    def add(name: str) -> None:
        for n in _NEEDS[name]:
            add(n)
        needed.setdefault(name)

    for s in steps:
        add(s)
    parts = [f"{n} AS MATERIALIZED ({_STEPS[n]})" for n in needed] + [f"{n} AS MATERIALIZED ({s})" for n, s in (more or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


_ranked = "SELECT qid, docid, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM {}) WHERE rank <= 10"
_WL = "SELECT qid, docid, round(sum(1.5e0 * tf / (0.5e0 * (0.7e0 + 0.3e0 * doc_len / avgdl) + tf) * idf), 4) AS score FROM lqr JOIN tf USING (term) JOIN dl USING (docid), st GROUP BY qid, docid"
_MB = "SELECT qid, docid, round(sum(idf), 4) AS score FROM q JOIN tf USING (term) GROUP BY qid, docid"
_BO = "SELECT q.qid, tf.docid, round(sum(q.idf), 4) AS score FROM rare JOIN tf AS r ON r.term = rare.term JOIN q ON q.qid = rare.qid JOIN tf ON tf.term = q.term AND tf.docid = r.docid GROUP BY q.qid, tf.docid"

# Candidates with the positions of the query's terms; pairs of neighbours.
_MORE = {
    "x": "SELECT c.qid, c.docid, ord, q.term, idf, cf, coalesce(tf, 0) AS tf, doc_len FROM c JOIN q USING (qid) JOIN dl USING (docid) LEFT JOIN tf ON tf.term = q.term AND tf.docid = c.docid",
    "pr": "SELECT c.qid, c.docid, a.ord, a.term AS t1, b.term AS t2 FROM c JOIN q AS a USING (qid) JOIN q AS b ON b.qid = a.qid AND b.ord = a.ord + 1",
    "p1": "SELECT qid, pr.docid, ord, t2, pos, lag(pos, 1, 0) OVER (PARTITION BY qid, pr.docid, ord ORDER BY pos) AS prev FROM pr JOIN tok ON tok.docid = pr.docid AND tok.term = t1",
    "p2": "SELECT p1.*, tok.pos AS n FROM p1 JOIN tok ON tok.docid = p1.docid AND tok.term = t2",
}


def _od(gap: int) -> str:
    return f"SELECT qid, docid, ord, count(DISTINCT pos) AS k FROM p2 WHERE n - pos BETWEEN 1 AND {gap + 1} GROUP BY ALL"


def _uw(window: int) -> str:
    w = 2 * window
    return (
        f"SELECT qid, docid, ord, sum(k) AS k FROM (SELECT qid, docid, ord, pos, count(*) FILTER (n > prev AND n < pos AND pos - n + 1 <= {w})"
        f" + max(CASE WHEN n > pos AND n - pos + 1 <= {w} THEN 1 ELSE 0 END) AS k FROM p2 GROUP BY ALL) GROUP BY ALL"
    )


def _bm25(tf: str, idf: str, k1: float, b: float) -> str:
    return f"CASE WHEN {tf} > 0 THEN {1 + k1}e0 * {tf} / ({k1}e0 * ({1 - b}e0 + {b}e0 * doc_len / avgdl) + {tf}) * {idf} ELSE 0e0 END"


def _dirichlet(tf: str, cf: str, mu: float) -> str:
    return f"ln(({tf} + {float(mu)}e0 * {cf} / total_len) / (doc_len + {float(mu)}e0))"


def _term(score: str) -> str:
    return f"SELECT qid, docid, sum({score}) AS v FROM x, st GROUP BY qid, docid"


def _pair(counts: str, score: str) -> str:
    return (
        f"SELECT c.qid, c.docid, coalesce(sum(CASE WHEN pr.ord IS NOT NULL THEN {score} END), 0e0) AS v FROM c JOIN dl USING (docid) LEFT JOIN pr ON pr.qid = c.qid AND pr.docid = c.docid"
        f" LEFT JOIN ({counts}) AS g ON g.qid = pr.qid AND g.docid = pr.docid AND g.ord = pr.ord, st GROUP BY c.qid, c.docid"
    )


_K = "coalesce(k, 0)"
_FEATURES = [
    _term(_bm25("tf", "idf", 0.5, 0.3)),
    _term(_dirichlet("tf", "cf", 1000)),
    _pair(_od(0), _bm25(_K, "default_idf", 0.5, 0.3)),
    _pair(_od(8), _bm25(_K, "default_idf", 1.2, 0.75)),
    _pair(_od(8), _dirichlet(_K, "default_cf", 1000)),
    _pair(_uw(4), _bm25(_K, "default_idf", 0.5, 0.3)),
    _pair(_uw(16), _bm25(_K, "default_idf", 1.2, 0.75)),
    _pair(_uw(8), _dirichlet(_K, "default_cf", 1000)),
]
_STATIC = "SELECT doc_id + 1 AS docid, CAST(max(quality) AS DOUBLE) AS quality FROM labels GROUP BY 1"
_ALL = _MORE | {f"v{i}": f for i, f in enumerate(_FEATURES, 1)} | {"s": _STATIC}
_ALL["fv"] = (
    "SELECT c.qid, c.docid, " + ", ".join(f"round(v{i}.v, 4) AS f{i}" for i in range(1, 9)) + ", round(coalesce(quality, 0e0), 4) AS f9 FROM c "
    + " ".join(f"JOIN v{i} ON v{i}.qid = c.qid AND v{i}.docid = c.docid" for i in range(1, 9)) + " LEFT JOIN s ON s.docid = c.docid"
)


def _feature(k: int) -> str:
    return _with("SELECT qid, docid, round(v, 4) AS value FROM v", "c", "tok", more=_MORE | {"v": _FEATURES[k]})


_TREES = (
    "CASE WHEN f1 <= 4e0 THEN 0.1e0 WHEN f2 <= -8e0 THEN 0.2e0 ELSE 0.3e0 END + CASE WHEN f4 > 0.5e0 THEN 0.5e0 WHEN f8 <= -20e0 THEN -0.5e0 ELSE -0.1e0 END"
    " + CASE WHEN f9 <= 0.5e0 THEN 0e0 ELSE 0.25e0 END"
)
_DOCNO = "SELECT doc_id + 1 AS docid, concat_ws('-', upper(source), lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS docno FROM documents"
_PAGE = r"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
_MESSAGES = f"SELECT row_number() OVER (ORDER BY conv_id * 1000 + turn) AS docid, {_tokens('text')} AS terms FROM conversations WHERE text IS NOT NULL"
_top = "SELECT qid, docid FROM sv QUALIFY row_number() OVER (PARTITION BY qid ORDER BY docid{}) <= 10"



def _bit(docid: str, words: str, a: int, b: int) -> str:
    return f"(({a} * ({docid} % {PRIME}) + {b}) % {PRIME}) % (32 * {words})"


# Blocks of 128 postings, their filters' words, and the first block that ends at or after each document asked for in "ask".
_BLOOM = {
    "pb": "SELECT term, docid, (row_number() OVER (PARTITION BY term ORDER BY docid) - 1) // 128 AS block FROM tf JOIN ts USING (term) WHERE df > 9",
    "bl": "SELECT term, block, max(docid) AS last, count(*) AS n, (count(*) * 8 + 31) // 32 AS words FROM pb GROUP BY term, block",
    "sb": " UNION ".join(f"SELECT term, block, {_bit('docid', 'words', a, b)} AS bit FROM pb JOIN bl USING (term, block)" for a, b in factors(3)),
    "wd": "SELECT term, block, bit // 32 AS w, CAST(sum(CAST(1 AS BIGINT) << CAST(bit % 32 AS INT)) AS BIGINT) AS v FROM sb GROUP BY ALL",
}
_INSIDE = {
    "ends": "SELECT ask.term, docid, min(last) AS last FROM ask JOIN bl ON bl.term = ask.term AND bl.last >= docid GROUP BY ask.term, docid",
    "told": "SELECT ask.term, ask.docid, coalesce(i.last = ask.docid OR ("
    + " AND ".join(f"EXISTS (SELECT 1 FROM sb WHERE sb.term = bl.term AND sb.block = bl.block AND sb.bit = {_bit('ask.docid', 'bl.words', a, b)})" for a, b in factors(3))
    + "), false) AS inside FROM ask LEFT JOIN ends AS i ON i.term = ask.term AND i.docid = ask.docid LEFT JOIN bl ON bl.term = i.term AND bl.last = i.last",
}
_PAIRS = "SELECT rare.qid, q.term, tf.docid FROM rare JOIN tf ON tf.term = rare.term JOIN (SELECT DISTINCT qid, term FROM q) AS q ON q.qid = rare.qid AND q.term <> rare.term"

SQL = {
    "bloom_blocks": _with(
        "SELECT term, block, last, n, filter FROM bl JOIN (SELECT term, block, string_agg(CAST(coalesce(v, 0) AS VARCHAR), ' ' ORDER BY w) AS filter"
        " FROM (SELECT term, block, unnest(range(words)) AS w FROM bl) LEFT JOIN wd USING (term, block, w) GROUP BY term, block) USING (term, block)",
        "tf", "ts", more=_BLOOM,
    ),
    "bloom_membership": _with(
        "SELECT term, docid, inside FROM told", "tf", "ts", "dl", more=_BLOOM | {"ask": "SELECT t.term, docid FROM dl, (VALUES ('the'), ('with')) t(term)"} | _INSIDE
    ),
    "bwand_and_bloom": _with(
        "SELECT rare.qid, docid FROM rare JOIN tf USING (term) WHERE NOT EXISTS (SELECT 1 FROM pair JOIN told USING (term, docid)"
        " WHERE pair.qid = rare.qid AND pair.docid = tf.docid AND NOT inside)",
        "rare", "q", "tf", "ts", more=_BLOOM | {"pair": _PAIRS, "ask": "SELECT DISTINCT term, docid FROM pair"} | _INSIDE,
    ),
    "dictionary": _with("SELECT row_number() OVER (ORDER BY seen) - 1 AS termid, term FROM (SELECT term, min((docid, pos)) AS seen FROM tok GROUP BY term)", "tok"),
    "doc_stats": _with("SELECT docid, doc_len FROM dl", "dl"),
    "collection_stats": _with("SELECT n_docs, total_len, round(avgdl, 4) AS avgdl, default_df, default_cf, round(default_idf, 4) AS default_idf FROM st", "st"),
    "term_stats": _with("SELECT term, df, cf FROM ts", "ts"),
    "postings_docids": _with("SELECT term, docid FROM tf", "tf"),
    "postings_tf": _with("SELECT term, docid, tf FROM tf", "tf"),
    "postings_positional": _with("SELECT term, docid, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions FROM tok GROUP BY term, docid", "tok"),
    "term_upper_bound": _with(
        "SELECT term, tf AS max_tf, doc_len AS max_tf_dl, round(1.5e0 * tf / (0.5e0 * (0.7e0 + 0.3e0 * doc_len / avgdl) + tf) * idf, 4) AS upper_bound FROM (SELECT tf.term, tf.tf, dl.doc_len, ts.idf, st.avgdl FROM tf JOIN dl USING (docid) JOIN ts USING (term), st WHERE df > 9"
        " QUALIFY row_number() OVER (PARTITION BY tf.term ORDER BY round(1.5e0 * tf.tf / (0.5e0 * (0.7e0 + 0.3e0 * doc_len / avgdl) + tf.tf), 9) DESC, tf.tf DESC, doc_len DESC) = 1)",
        "tf", "dl", "ts", "st",
    ),
    "doc_vectors": _with("SELECT docid, array_to_string(terms, ' ') AS terms FROM d", "d"),
    "term_lookup": _with(
        "SELECT term, coalesce(termid, -1) AS termid FROM (SELECT unnest(['the', 'of', 'and', 'nosuchterm']) AS term) LEFT JOIN (SELECT row_number() OVER (ORDER BY seen) - 1 AS termid, term FROM (SELECT term, min((docid, pos)) AS seen FROM tok GROUP BY term)) USING (term)",
        "tok",
    ),
    "postings_lookup": _with("SELECT docid, tf FROM tf JOIN ts USING (term) WHERE term = 'the' AND df > 9", "tf", "ts"),
    "vocab_df": _with("SELECT term, df FROM ts WHERE df > 9", "ts"),
    "doc_vector_lookup": _with("SELECT docid, array_to_string(terms, ' ') AS terms FROM d WHERE docid IN (1, 7, 100, 1000000000)", "d"),
    "resolve_query_terms": _with("SELECT qid, ord, term, df, round(idf, 4) AS idf FROM q", "q"),
    "rarest_term": _with("SELECT qid, term, df FROM rare", "rare"),
    "query_positions": _with(
        "SELECT qid, term, docid, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions FROM sv JOIN (SELECT DISTINCT qid, term FROM lq WHERE pos <= 4) USING (qid) JOIN tok USING (docid, term) GROUP BY qid, term, docid",
        "sv", "lq", "tok",
    ),
    "svs_and": _with("SELECT qid, docid FROM sv", "sv"),
    "svs_and_topk": _with(_top.format(""), "sv"),
    "svs_recent": _with(_top.format(" DESC"), "sv"),
    "intersect_two_terms": _with(
        "SELECT docid FROM tf JOIN ts USING (term) WHERE term = 'the' AND df > 9 INTERSECT SELECT docid FROM tf JOIN ts USING (term) WHERE term = 'of' AND df > 9", "tf", "ts"
    ),
    "bwand_and": _with("SELECT qid, docid FROM sv", "sv"),
    "wand_bm25_topk": _with(_ranked.format("w"), "w"),
    "wand_bm25_long_topk": _with(_ranked.format("wl"), "lqr", "tf", "dl", "st", more={"wl": _WL}),
    "mbwand_idf_topk": _with("SELECT qid, docid FROM (" + _ranked.format("mb") + ")", "q", "tf", more={"mb": _MB}),
    "bwand_or_topk": _with(_ranked.format("bo"), "rare", "tf", more={"bo": _BO}),
    "idf": _with("SELECT term, df, round(idf, 4) AS idf FROM ts", "ts"),
    "bm25_term_scores": _with(
        "SELECT term, docid, round(1.5e0 * tf / (0.5e0 * (0.7e0 + 0.3e0 * doc_len / avgdl) + tf) * idf, 4) AS score FROM tf JOIN dl USING (docid) JOIN ts USING (term), st WHERE df > 9",
        "tf", "dl", "ts", "st",
    ),
    "feature_term_bm25": _feature(0),
    "feature_term_dirichlet": _feature(1),
    "feature_od_bm25": _feature(3),
    "feature_od_dirichlet": _feature(4),
    "feature_uw_bm25": _feature(6),
    "feature_uw_dirichlet": _feature(7),
    "static_features": _with("SELECT qid, c.docid, coalesce(quality, 0e0) AS quality FROM c LEFT JOIN s ON s.docid = c.docid", "c", more={"s": _STATIC}),
    "feature_vectors": _with("SELECT * FROM fv", "c", "tok", more=_ALL),
    "lambdamart_rerank": _with(
        f"SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM (SELECT qid, docid, round({_TREES}, 4) AS score FROM fv)",
        "c", "tok", more=_ALL,
    ),
    "docno_join": _with(f"SELECT qid, docid, docno FROM ({_top.format('')}) JOIN ({_DOCNO}) USING (docid)", "sv"),
    "trec_run": _with(
        f"SELECT qid, rank, concat_ws(' ', qid, 'Q0', docno, rank, printf('%.6f', score), 'fathom') AS line FROM ({_ranked.format('w')}) JOIN ({_DOCNO}) USING (docid)", "w"
    ),
    "set_output": _with("SELECT concat_ws(' ', qid, docid) AS line FROM (" + _ranked.format("mb") + ")", "q", "tf", more={"mb": _MB}),
    "vector_lines": _with(
        "SELECT qid, docid, concat_ws(' ', qid, docid, " + ", ".join(f"'{i}:' || printf('%.6f', f{i})" for i in range(1, 10)) + ") AS line FROM fv", "c", "tok", more=_ALL
    ),
    "parse_pages": f"SELECT page_id + 1 AS docid, array_to_string({_tokens(_PAGE)}, ' ') AS terms FROM pages",
    "parse_messages": f"SELECT docid, array_to_string(terms, ' ') AS terms FROM ({_MESSAGES}) WHERE len(terms) > 0",
    "reverse_messages": (
        f"WITH m AS ({_MESSAGES}), t AS (SELECT DISTINCT docid, unnest(terms) AS term FROM m), f AS (SELECT term FROM t GROUP BY term HAVING count(*) > 9),"
        " q AS (SELECT * FROM (VALUES (1, 'the'), (1, 'of'), (2, 'de'), (2, 'la')) v(qid, term) JOIN f USING (term)), n AS (SELECT qid, count(*) AS n FROM q GROUP BY qid)"
        " SELECT qid, docid FROM (SELECT qid, docid, count(*) AS k FROM q JOIN t USING (term) GROUP BY qid, docid) JOIN n USING (qid) WHERE k = n"
        " QUALIFY row_number() OVER (PARTITION BY qid ORDER BY docid DESC) <= 10"
    ),
}

# The same over whole items of the benchmark.
for _name, _short in (
    ("svs_and_long", "svs_and"), ("mbwand_idf_long_topk", "mbwand_idf_topk"), ("bwand_or_long_topk", "bwand_or_topk"), ("feature_vectors_long", "feature_vectors"),
    ("lambdamart_rerank_long", "lambdamart_rerank"),
):
    SQL[_name] = SQL[_short].replace(" AND pos <= 4", "")

# Bounds change the way, not the rows.
SQL |= {"wand_bounded_topk": SQL["wand_bm25_topk"], "wand_bounded_long_topk": SQL["wand_bm25_long_topk"]}

# What is written and read back is the same; so are an ensemble's scores, compiled or walked.
SQL |= {
    "line_files": SQL["doc_vectors"],
    "query_file": _with("SELECT qid, pos AS ord, term FROM lq", "b", "lq"),
    "docno_file": "SELECT row_number() OVER (ORDER BY docid) AS docid, docno FROM (" + _DOCNO + ")",
    "trec_files": SQL["parse_pages"],
    "status_files": SQL["parse_messages"],
    "compacted_index": SQL["postings_tf"],
    "walked_rerank": SQL["lambdamart_rerank"],
    "command_line": _with(f"SELECT concat_ws(' ', qid, 'Q0', docid, rank, printf('%.6f', score), 'fathom') AS line FROM ({_ranked.format('w')})", "w"),
}
