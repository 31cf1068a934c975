"""DuckDB SQL for the queries of ``catalog``."""

from __future__ import annotations

from tabularium.functions.masking import MASK, PATTERNS
from tabularium.operators.match import SYNONYMS
from tabularium.operators.profile import STEPS
from tabularium.sources.registry import MODELS
from tabularium.sources.synthetic import COLUMNS

ORDER_HEADERS = ("order_key", "customer_key", "order_status", "total_price", "order_date", "order_priority")

#: Trees over the numbers of an order: feature, threshold, what is at most the threshold, what is above.
TREES = (
    ("month", 6, ("totalprice", 1.5, 0.25, -0.5), ("custkey", 0.5, 0.375, ("totalprice", 1.0, -0.125, 0.625))),
    ("custkey", 0.75, ("month", 3, 0.5, -0.25), ("month", 9, ("month", 7, 0.125, 1.0), -0.5)),
)

#: Ends of bins of these numbers.
EDGES = {"totalprice": (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0), "custkey": (0.25, 0.5, 0.75, 1.0, 1.25), "month": tuple(range(1, 12))}

_TABLES = {
    "lineitem": ("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax", "l_returnflag l_linestatus", "l_shipdate"),
    "orders": ("o_orderkey o_custkey o_totalprice", "o_orderstatus o_orderpriority", "o_orderdate"),
    "customer": ("c_custkey c_nationkey c_acctbal", "c_name c_mktsegment", ""),
    "part": ("p_partkey p_size p_retailprice", "p_name p_brand p_type", ""),
    "supplier": ("s_suppkey s_nationkey s_acctbal", "s_name", ""),
    "events": ("event_id user_id value", "event_type props", "ts"),
    "documents": ("doc_id n_chars", "text lang source", ""),
    "labels": ("doc_id quality toxic", "", ""),
}


def _pattern(label: str) -> str:
    """For an engine without look-around, which changes nothing on these tables."""
    plain = PATTERNS[label].replace(r"(?<!\d)", "").replace(r"(?!\d)", "")
    return ("(?i)" if label == "MRN" else "") + plain


def _masked(column: str, upto: int = len(PATTERNS)) -> str:
    out = column
    for label in list(PATTERNS)[:upto]:
        out = f"regexp_replace({out}, '{_pattern(label)}', '{MASK}', 'g')"
    return out


def _mask_query(table: str, keys: str, text: str) -> str:
    return f"SELECT {keys}, md5({_masked(text)}) AS masked_md5, CAST(length({_masked(text)}) AS INTEGER) AS masked_length FROM {table}"


def _fires(table: str, column: str) -> str:
    parts = [f"SELECT '{column}' AS \"column\", '{label}' AS label FROM {table} WHERE regexp_matches({_masked(column, k)}, '{_pattern(label)}')" for k, label in enumerate(PATTERNS)]
    return " UNION ALL ".join(parts)


def _columns(table: str) -> list[tuple[str, str]]:
    return [(c, kind) for names, kind in zip(_TABLES[table], ("number", "text", "other")) for c in names.split()]


def _tree(node: tuple | float, column: dict[str, str]) -> str:
    if not isinstance(node, tuple):
        return str(node)
    feature, threshold, left, right = node
    return f"CASE WHEN {column[feature]} <= {threshold} THEN {_tree(left, column)} ELSE {_tree(right, column)} END"


def _tree_shap() -> str:
    """All coalitions of the three numbers of an order, each the mean over the background rows."""
    names = ("totalprice", "custkey", "month")
    values = [" + ".join(_tree(t, {n: f"{'r' if s >> k & 1 else 'b'}.{n}" for k, n in enumerate(names)}) for t in TREES) for s in range(8)]
    weight = (1 / 3, 1 / 6, 1 / 3)
    phi = [" + ".join(f"{weight[s.bit_count()]!r} * (v{s | 1 << k} - v{s})" for s in range(8) if not s >> k & 1) for k in range(3)]
    columns = ", ".join(f"round({e}, 6) AS {n}" for e, n in zip(phi, names))
    means = ", ".join(f"avg({v}) AS v{s}" for s, v in enumerate(values))
    return f"WITH r AS ({_NUMBERS}), b AS (SELECT * FROM r ORDER BY md5('0|' || o_orderkey), o_orderkey LIMIT 100), v AS (SELECT r.o_orderkey, {means} FROM r, b GROUP BY 1) SELECT o_orderkey, {columns} FROM v"


def _boost_gains() -> str:
    """Derivatives of the softmax loss of an order's status, where the trees have been added to the first two classes, and the gains of all splits."""
    start = "WITH c AS (SELECT s, 1.0 + (SELECT count(*) FROM orders WHERE o_orderstatus = s) AS n FROM (VALUES ('F'), ('O'), ('P')) t(s)), b AS (SELECT s, ln(n / (SELECT sum(n) FROM c)) AS b FROM c)"
    plain = {n: n for n in EDGES}
    margins = [f"{_tree(TREES[0], plain)} + (SELECT b FROM b WHERE s = 'F')", f"{_tree(TREES[1], plain)} + (SELECT b FROM b WHERE s = 'O')", "(SELECT b FROM b WHERE s = 'P')"]
    rows = f"x AS (SELECT x.*, o_orderstatus AS s FROM ({_NUMBERS}) x JOIN orders USING (o_orderkey)), e AS (SELECT *, exp({margins[0]}) AS e0, exp({margins[1]}) AS e1, exp({margins[2]}) AS e2 FROM x)"
    by_class = " UNION ALL ".join(f"SELECT {k} AS output, e{k} / (e0 + e1 + e2) AS p, s = '{s}' AS hot, totalprice, custkey, month FROM e" for k, s in enumerate("FOP"))
    count = lambda n: " + ".join(f"CAST({n} > {v} AS INTEGER)" for v in EDGES[n])
    by_feature = " UNION ALL ".join(f"SELECT output, {k} AS feature, {count(n)} AS bin, p - CAST(hot AS INTEGER) AS g, p * (1 - p) AS h FROM q" for k, n in enumerate(EDGES))
    return f"""{start}, {rows}, q AS ({by_class}), f AS ({by_feature}), s AS (SELECT output, feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM f GROUP BY ALL),
u AS (SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl, sum(g) OVER a AS gt, sum(h) OVER a AS ht, sum(n) OVER a AS nt FROM s WINDOW w AS (PARTITION BY output, feature ORDER BY bin), a AS (PARTITION BY output, feature))
SELECT output, feature, bin, CAST(nl AS BIGINT) AS n_left, CASE WHEN nl >= 5 AND nt - nl >= 5 THEN round((gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) / nt, 8) END AS gain FROM u"""


def _profile(table: str) -> str:
    parts = []
    for c, kind in _columns(table):
        length = f"round(avg(length({c})), 6)" if kind == "text" else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS \"column\", '{kind}' AS kind, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_unique, {length} AS avg_len FROM {table}")
    return " UNION ALL ".join(parts)


def _types(table: str) -> str:
    return f"""
SELECT "column", CASE WHEN n_unique = 2 THEN 'Binary'
  WHEN kind = 'number' AND n_unique > 0.8 * n_rows THEN 'Numerical'
  WHEN kind = 'text' AND n_unique <= greatest(20, 0.05 * n_rows) AND avg_len <= 25 THEN 'Categorical'
  WHEN kind = 'text' THEN 'Textual'
  WHEN kind = 'number' AND n_unique <= 20 THEN 'Categorical' ELSE 'Numerical' END AS type
FROM ({_profile(table)})"""


_LEVELS = {
    "o_orderpriority": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"),
    "c_mktsegment": ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
}


def _gaps(key: str, value: str) -> str:
    return f"CASE WHEN {key} % 7 <> 0 THEN {value} END"


def _mode(value: str, source: str) -> str:
    return f"(SELECT {value} FROM {source} WHERE {value} IS NOT NULL GROUP BY {value} ORDER BY count(*) DESC, {value} LIMIT 1)"


def _one_hot(table: str, key: str, column: str) -> str:
    cells = ", ".join(f"CASE WHEN v = '{x}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"{column}_{x}\"" for x in _LEVELS[column])
    return f"WITH g AS (SELECT {key}, {_gaps(key, column)} AS x FROM {table}), f AS (SELECT {key}, coalesce(x, {_mode('x', 'g')}) AS v FROM g) SELECT {key}, {cells} FROM f"


_TEXTS = """CASE p_partkey % 8 WHEN 0 THEN ' ' || p_partkey || ' ' WHEN 1 THEN p_partkey || 'e1' WHEN 2 THEN p_partkey || 'd' WHEN 3 THEN 'M'
  WHEN 4 THEN '-' || p_partkey || '.5' WHEN 5 THEN '' WHEN 6 THEN '0x' || p_partkey ELSE '.' || p_partkey END"""

_STATUS = "SELECT *, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y FROM orders"


def _split(source: str = _STATUS, test: str = "0.2") -> str:
    """Training rows of each class by largest remainder, as a chain of common table expressions ending in ``sp``."""
    return f"""
WITH s AS ({source}),
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42|' || o_orderkey), o_orderkey) AS split_pos FROM s),
n AS (SELECT count(*) AS n, count(*) - CAST(ceil(count(*) * {test}::DOUBLE) AS BIGINT) AS n_train FROM s),
c AS (SELECT y, count(*) * n_train * 1e0 / n AS exact FROM s, n GROUP BY y, n_train, n),
l AS (SELECT y, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, y) <= n_train - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS keep FROM c, n),
sp AS (SELECT r.*, split_pos > keep AS is_test FROM r JOIN l USING (y))"""


def _cohort_rows() -> list[str]:
    rows = []
    for m in MODELS:
        if m.kind == "table":
            rows += [f"('{m.name}', 'user', {k}, '{h}')" for k, h in enumerate((*COLUMNS, "anxiety"))]
            rows += [f"('{m.name}', 'required', {k}, '{h}')" for k, h in enumerate(x for x in m.headers if x != m.output)]
    return rows


def _order_rows() -> list[str]:
    numbers, texts, others = (names.split() for names in _TABLES["orders"])
    columns = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    assert sorted(columns) == sorted([*numbers, *texts, *others])
    return [f"('ORDERS', 'user', {k}, '{h}')" for k, h in enumerate(columns)] + [f"('ORDERS', 'required', {k}, '{h}')" for k, h in enumerate(ORDER_HEADERS)]


#: Given tables whose columns are models of a registry, and those whose columns are to be matched.
REGISTERED = ("customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")
MATCHED = ("orders", "lineitem", "customer", "part", "nation")
SHORT = "^[a-z]_"
_ORDER = " ".join(f"WHEN '{t}' THEN {k}" for k, t in enumerate(MATCHED))


def _described(tables: tuple[str, ...]) -> str:
    """(table_name, column_name, o) of given tables."""
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, row_number() OVER () AS o FROM (DESCRIBE {t})" for t in tables)


#: Models of the registry: a table's columns without the table's letter, the last one as output.
_MODELS = f"SELECT table_name AS model, regexp_replace(column_name, '{SHORT}', '') AS header, o, count(*) OVER (PARTITION BY table_name) AS n FROM ({_described(REGISTERED)})"
_TABLE_HEADERS = f"""(WITH m AS ({_MODELS}), q AS (SELECT m.model, m.header, m.o FROM m JOIN m AS l ON l.model = m.model AND l.o = l.n WHERE m.header <> l.header),
u AS (SELECT column_name AS header, row_number() OVER (ORDER BY CASE table_name {_ORDER} END, o) - 1 AS idx FROM ({_described(MATCHED)}))
SELECT model, 'required', CAST(row_number() OVER (PARTITION BY model ORDER BY o) - 1 AS INTEGER), header FROM q UNION ALL SELECT model, 'user', CAST(idx AS INTEGER), u.header FROM u, (SELECT DISTINCT model FROM m))"""


def _run_report() -> str:
    keys = ("data_kind", "file_types", "selected_model", "target", "n_classes", "valid_headers", "column_types", "anonymization", "match_report", "metrics", "explanations", "trace")
    stages = ("identify", "anonymize", "features", "match", "recommend", "prepare", "infer")
    rows = [("key", k, x) for k, x in enumerate(keys)] + [("stage", k, f"{x} ok") for k, x in enumerate(stages)] + [("header", k, x) for k, x in enumerate(("source", "n_chars", "text"))]
    rows += [("decision", "data_kind", "tabular"), ("decision", "selected_model", "ENGLISH"), ("decision", "target", "english"), ("explanations", "note", "skipped"), ("predictions", "last", "y_true,y_pred,y_score")]
    n_features = "(SELECT 1 + count(DISTINCT source) FROM documents)"
    n_test = "(SELECT CAST(ceil(count(*) * 0.2) AS BIGINT) FROM documents)"
    computed = {("metric", "n_train"): f"(SELECT count(*) FROM documents) - {n_test}", ("metric", "n_test"): n_test, ("metric", "n_features"): n_features, ("predictions", "lines"): n_test, ("predictions", "columns"): f"{n_features} + 3", ("decision", "n_classes"): "(SELECT count(DISTINCT coalesce(lang = 'en', false)) FROM documents)"}
    parts = [f"SELECT '{a}' AS part, '{b}' AS key, CAST({e} AS VARCHAR) AS value" for (a, b), e in computed.items()]
    return f"""SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in rows)}) AS t(part, key, value) UNION ALL {" UNION ALL ".join(parts)}
UNION ALL SELECT 'type', "column", type FROM ({_types('documents')}) WHERE "column" IN ('source', 'n_chars', 'text')"""


def _command_line() -> str:
    names = "(SELECT string_agg(column_name, ', ' ORDER BY o) FROM (SELECT column_name, row_number() OVER () AS o FROM (DESCRIBE customer)))"
    kinds = "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END"
    return f"""SELECT 'info' AS command, 'size' AS key, (SELECT count(*) FROM customer) || ' rows, ' || (SELECT count(*) FROM (DESCRIBE customer)) || ' columns' AS value
UNION ALL SELECT 'info', column_name, {kinds} || '|' || n_unique || '|' || n_null FROM (DESCRIBE customer) JOIN ({_profile('customer')}) p ON p."column" = column_name
UNION ALL SELECT 'target', 'said', 'FILE has no column ''zzz'' to predict; it has: ' || {names}
UNION ALL SELECT * FROM (VALUES ('info', 'exit', '0'), ('target', 'exit', '2'), ('run', 'exit', '0'), ('run', 'files', 'pipeline_report.json'), ('run', 'halted', 'True'))"""


def _run_without_model() -> str:
    said = "'target column ''ruler'' not in data; columns: n_nationkey, n_regionkey, _row_id'"
    stages = [f"('nation', 'stage {k}', '{x}')" for k, x in enumerate(("identify ok", "anonymize ok", "features ok", "match ok", "recommend ok", "prepare error"))]
    return f"""SELECT 'region' AS run, 'headers' AS key, string_agg(column_name, ',' ORDER BY o) AS value FROM (SELECT column_name, row_number() OVER () AS o FROM (DESCRIBE region))
UNION ALL SELECT * FROM (VALUES ('region', 'model', 'None'), ('region', 'target', 'r_name'), ('region', 'last', 'halted'), ('nation', 'error', {said}), {", ".join(stages)})"""


def _headers(rows: list[str] | None = None, query: str = "") -> str:
    """Headers as (model, side, idx, header), normalised in ``nh``, in common table expressions."""
    rows = rows or _cohort_rows()
    synonyms = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SYNONYMS.items())
    return f"""
WITH RECURSIVE hd(model, side, idx, header) AS ({query or "VALUES " + ", ".join(rows)}),
w AS (SELECT model, side, idx, unnest(string_split(translate(lower(header), '_-', '  '), ' ')) AS w, unnest(range(1, 99)) AS o FROM hd),
k AS (SELECT model, side, idx, o, CASE w {synonyms} ELSE w END AS w FROM w WHERE w IS NOT NULL AND w <> ''),
nh AS (SELECT model, side, idx, string_agg(w, ' ' ORDER BY o) AS header FROM k GROUP BY ALL)"""


_GRAMS = """,
pw AS (SELECT model, side, idx, ' ' || unnest(string_split(header, ' ')) || ' ' AS p FROM nh),
sz AS (SELECT *, unnest(range(2, least(4, length(p)) + 1)) AS n FROM pw),
gr AS (SELECT model, side, idx, substr(p, CAST(i AS INTEGER), CAST(n AS INTEGER)) AS gram FROM (SELECT *, unnest(range(1, length(p) - n + 2)) AS i FROM sz)),
tf AS (SELECT model, side, idx, gram, count(*) AS tf FROM gr GROUP BY ALL)"""

_WEIGHTS = """,
nd AS (SELECT model, count(*) AS n FROM hd GROUP BY model),
rw AS (SELECT tf.*, tf * (ln((1 + n) / (1 + count(*) OVER (PARTITION BY model, gram))) + 1) AS raw FROM tf JOIN nd USING (model)),
wt AS (SELECT model, side, idx, gram, raw / sqrt(sum(raw * raw) OVER (PARTITION BY model, side, idx)) AS w FROM rw)"""

_SIMILAR = """,
sh AS (SELECT r.model, r.idx AS req_idx, u.idx AS user_idx, sum(r.w * u.w) AS sim FROM wt r JOIN wt u ON r.model = u.model AND r.gram = u.gram AND r.side = 'required' AND u.side = 'user' GROUP BY ALL),
sm AS (SELECT r.model, r.idx AS req_idx, u.idx AS user_idx, coalesce(sim, 0) AS sim FROM hd r JOIN hd u ON r.model = u.model AND r.side = 'required' AND u.side = 'user'
       LEFT JOIN sh ON sh.model = r.model AND sh.req_idx = r.idx AND sh.user_idx = u.idx)"""

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Similarities of counts of letters.
_BY_LETTERS = f""",
lv AS (SELECT *, [{", ".join(f"length(lower(header)) - length(replace(lower(header), '{c}', ''))" for c in LETTERS)}] AS v FROM hd),
sm AS (SELECT r.model, r.idx AS req_idx, u.idx AS user_idx, list_sum(list_transform(list_zip(r.v, u.v), lambda x: x[1] * x[2])) / sqrt(list_sum(list_transform(r.v, lambda x: x * x)) * list_sum(list_transform(u.v, lambda x: x * x))) AS sim
       FROM lv r JOIN lv u ON r.model = u.model AND r.side = 'required' AND u.side = 'user'),
nd AS (SELECT DISTINCT model FROM hd)"""

#: One required header after the other, by its best similarity, takes the best free header of the table.
_ASSIGN = """,
od AS (SELECT model, req_idx, row_number() OVER (PARTITION BY model ORDER BY max(round(sim, 12)) DESC, req_idx) AS turn FROM sm GROUP BY model, req_idx),
ag(model, turn, taken, req_idx, user_idx, sim) AS (
  SELECT model, CAST(0 AS BIGINT), CAST([] AS INTEGER[]), CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), CAST(NULL AS DOUBLE) FROM nd
  UNION ALL
  SELECT p.model, p.turn + 1, CASE WHEN b.sim > 0.6 THEN list_append(p.taken, b.user_idx) ELSE p.taken END, b.req_idx, b.user_idx, b.sim
  FROM ag p JOIN (
    SELECT q.model, q.turn, o.req_idx, arg_max(CAST(s.user_idx AS INTEGER), struct_pack(a := round(s.sim, 12), b := -s.user_idx)) AS user_idx, max(round(s.sim, 12)) AS sim
    FROM ag q JOIN od o ON o.model = q.model AND o.turn = q.turn + 1 JOIN sm s ON s.model = o.model AND s.req_idx = o.req_idx
    WHERE NOT list_contains(q.taken, CAST(s.user_idx AS INTEGER)) GROUP BY q.model, q.turn, o.req_idx
  ) b ON b.model = p.model AND b.turn = p.turn),
mt AS (SELECT ag.model, r.header AS required, u.header, round(ag.sim, 3) AS score FROM ag
       JOIN hd r ON r.model = ag.model AND r.side = 'required' AND r.idx = ag.req_idx JOIN hd u ON u.model = ag.model AND u.side = 'user' AND u.idx = ag.user_idx WHERE ag.sim > 0.6)"""

_PLACED = """tn AS (SELECT ag.model, ag.turn, r.header AS required, u.header, round(ag.sim, 3) AS score FROM ag JOIN hd r ON r.model = ag.model AND r.side = 'required' AND r.idx = ag.req_idx JOIN hd u ON u.model = ag.model AND u.side = 'user' AND u.idx = ag.user_idx WHERE ag.sim > 0.6) SELECT model, CAST(row_number() OVER (PARTITION BY model ORDER BY turn) - 1 AS INTEGER) AS place, required, header, score FROM tn"""

_SCORED = "SELECT doc_id, quality AS y, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS p, n_chars / 100.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id)"
_CONFUSION = f"""
WITH s AS ({_SCORED}), lb AS (SELECT DISTINCT unnest([y, p]) AS v FROM s)
SELECT a.v AS y, b.v AS p, count(s.doc_id) AS n FROM lb a CROSS JOIN lb b LEFT JOIN s ON s.y = a.v AND s.p = b.v GROUP BY ALL"""

_NUMBERS = "SELECT o_orderkey, o_totalprice / 1e5 AS totalprice, o_custkey / 1e3 AS custkey, CAST(month(o_orderdate) AS DOUBLE) AS month FROM orders"


_ORDERS = """SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, o_orderpriority, CASE WHEN o_orderkey % 5 = 0 THEN 'say "' || o_orderstatus || '", then' END AS o_note FROM orders"""


def _coalition(own: str) -> str:
    """The mean prediction where the features named in ``own`` are the row's and the others the background's."""
    t, c, m = (f"{'e' if x in own else 'b'}.{name}" for x, name in (("t", "totalprice"), ("c", "custkey"), ("m", "month")))
    return f"avg(1 / (1 + exp(-({t} - 0.5 * {c} * {m} + 0.125 * {m})))) AS v_{own}"


_SHAP = f"""WITH x AS ({_NUMBERS}), b AS (SELECT * FROM x ORDER BY md5('0|' || o_orderkey), o_orderkey LIMIT 100), e AS (SELECT * FROM x ORDER BY o_orderkey LIMIT 100),
v AS (SELECT e.o_orderkey, {", ".join(_coalition(s) for s in ("", "t", "c", "m", "tc", "tm", "cm", "tcm"))} FROM e, b GROUP BY e.o_orderkey),
i AS (SELECT 'totalprice' AS feature, avg(abs((v_t - v_) / 3 + (v_tc - v_c) / 6 + (v_tm - v_m) / 6 + (v_tcm - v_cm) / 3)) AS v, 1 AS o FROM v
UNION ALL SELECT 'custkey', avg(abs((v_c - v_) / 3 + (v_tc - v_t) / 6 + (v_cm - v_m) / 6 + (v_tcm - v_tm) / 3)), 2 FROM v
UNION ALL SELECT 'month', avg(abs((v_m - v_) / 3 + (v_tm - v_t) / 6 + (v_cm - v_c) / 6 + (v_tcm - v_tc) / 3)), 3 FROM v)
SELECT CAST(row_number() OVER (ORDER BY v DESC, o) AS INTEGER) AS rank, feature, round(v, 5) AS importance FROM i"""


def _quoted(x: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if x is None else "'" + x.replace("'", "''") + "'"


def _registry() -> str:
    rows = [f"({_quoted(m.name)}, {_quoted(m.kind)}, {_quoted(m.modality)}, {_quoted(','.join(m.headers))}, {_quoted(m.output)}, {_quoted(m.caption)}, {_quoted(m.task)}, {k})" for k, m in enumerate(MODELS)]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS r(model, kind, modality, headers, output, caption, task, ord)"


def sql() -> dict[str, str]:
    out = {
        "mask_documents": _mask_query("documents", "doc_id", "text"),
        "mask_pages": _mask_query("pages", "page_id", "html"),
        "mask_conversations": _mask_query("conversations", "conv_id, turn", "text"),
        "pii_hits_by_label": f"SELECT \"column\", label, count(*) AS n FROM ({' UNION ALL '.join(_fires('documents', c) for c in ('text', 'lang', 'source'))}) GROUP BY ALL",
        "pii_report": f"SELECT 'record_url' AS \"column\", 'column_name_hint' AS reason, 'IDENTITY' AS labels UNION ALL SELECT \"column\", 'patterns', string_agg(DISTINCT label, ',' ORDER BY label) FROM ({_fires('pages', 'html')}) GROUP BY 1",
        "mask_hint_columns": f"SELECT c_custkey, '{MASK}' AS c_name, c_nationkey, c_acctbal, {_masked('c_mktsegment')} AS c_mktsegment FROM customer",
        "mask_hint_supplier": f"SELECT s_suppkey, '{MASK}' AS s_name, s_nationkey, s_acctbal FROM supplier",
        "plan_steps": f"SELECT \"column\", type, CASE type {' '.join(f"WHEN '{t}' THEN '{','.join(s)}'" for t, s in STEPS.items())} END AS steps FROM ({_types('orders')})",
        "project_headers": "SELECT c_mktsegment, c_acctbal, c_custkey FROM customer",
        "impute_median": f"WITH g AS (SELECT o_orderkey, {_gaps('o_orderkey', 'o_totalprice')} AS x FROM orders) SELECT o_orderkey, round(coalesce(x, (SELECT median(x) FROM g)), 6) AS o_totalprice FROM g",
        "impute_mode": f"WITH g AS (SELECT p_partkey, {_gaps('p_partkey', 'p_brand')} AS x FROM part) SELECT p_partkey, coalesce(x, {_mode('x', 'g')}) AS p_brand FROM g",
        "impute_mode_numeric": f"WITH g AS (SELECT p_partkey, {_gaps('p_partkey', 'p_size')} AS x FROM part) SELECT p_partkey, CAST(coalesce(x, {_mode('x', 'g')}) AS DOUBLE) AS p_size FROM g",
        "binary_strings": "SELECT l_orderkey, 0.0::DOUBLE AS l_linestatus FROM lineitem",
        "coerce_numeric": f"WITH t AS (SELECT p_partkey, trim({_TEXTS}) AS x FROM part) SELECT p_partkey, round(CASE WHEN regexp_matches(x, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN try_cast(x AS DOUBLE) END, 6) AS number FROM t",
        "csv_types": "SELECT * FROM (VALUES ('whole', 'bigint'), ('whole_with_gaps', 'double'), ('fraction', 'double'), ('flag', 'boolean'), ('empty', 'double'), ('dash', 'string'), ('day', 'string')) AS t(\"column\", type)",
        "one_hot_wide": f"""WITH g AS (SELECT p_partkey, {_gaps('p_partkey', "'k' || (p_partkey % 1500)")} AS x FROM part), f AS (SELECT p_partkey, coalesce(x, {_mode('x', 'g')}) AS level FROM g),
l AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS place, count(*) OVER () AS width FROM (SELECT DISTINCT level FROM f))
SELECT p_partkey, place, level, CAST(width AS INTEGER) AS width FROM f JOIN l USING (level)""",
        "load_csv": _ORDERS,
        "load_tsv": _ORDERS,
        "load_sav": "SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, rtrim(p_name) AS p_name, rtrim(p_brand) AS p_brand, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS p_size, round(CAST(p_retailprice AS DOUBLE), 6) AS p_retailprice FROM part",
        "load_parquet": "SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events",
        "load_xlsx": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, n_nationkey / 4e0 AS n_quarter, n_nationkey % 2 = 0 AS n_even FROM nation",
        "predictions_csv": f"WITH x AS ({_NUMBERS}), s AS (SELECT *, 1 / (1 + exp(-(0.5 * totalprice + -0.25 * custkey + 0.125 * month))) AS score FROM x) SELECT round(totalprice, 8) AS totalprice, round(custkey, 8) AS custkey, month, o_orderkey % 2 AS y_true, CAST(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS y_pred, round(score, 4) AS y_score FROM s",
        "file_kind": "SELECT * FROM (VALUES ('region.parquet', 'parquet', 'tabular'), ('nation.parquet', 'parquet', 'tabular'), ('supplier.parquet', 'parquet', 'tabular')) AS t(name, labels, data_kind)",
        "archive_kinds": """WITH p AS (SELECT page_id, lower(substr(html, 1, 1000)) AS head, html, 'pages-' || (page_id // 100) || '.zip' AS archive FROM pages),
m AS (SELECT archive, 'p' || page_id || '.html' AS name, CASE WHEN coalesce(html, '') = '' THEN 'empty' WHEN substr(ltrim(html), 1, 1) <> '<' THEN 'txt' WHEN contains(head, '<html') OR contains(head, '<!doctype html') THEN 'html' ELSE 'xml' END AS label FROM p
UNION ALL SELECT archive, 'p' || page_id || '.csv', 'csv' FROM p)
SELECT *, count(*) OVER (PARTITION BY archive) AS members FROM m""",
        "run_demo": "SELECT 'tabular' AS data_kind, 'MODEL_01' AS model, 'anxiety' AS target, 2 AS n_classes, 21 AS n_headers, 480 AS n_train, 120 AS n_test, 67 AS n_features, 'ok,ok,ok,ok,ok,ok,ok' AS stages",
        "shap_exact": _SHAP,
        "level_names": "SELECT \"column\", level, count(*) AS n FROM (SELECT 'l_linenumber' AS \"column\", CAST(l_linenumber AS VARCHAR) AS level FROM lineitem UNION ALL SELECT 'l_quantity', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.0' FROM lineitem UNION ALL SELECT 'l_discount', CAST(l_discount AS VARCHAR) FROM lineitem) GROUP BY ALL",
        "one_hot_priority": _one_hot("orders", "o_orderkey", "o_orderpriority"),
        "one_hot_segment": _one_hot("customer", "c_custkey", "c_mktsegment"),
        "target_binary": f"SELECT event_id, CASE WHEN coalesce({_gaps('event_id', 'value')}, 0) >= 1 THEN 1 ELSE 0 END AS y FROM events",
        "target_binary_text": "WITH o AS (SELECT l_orderkey, min(l_linestatus) AS s FROM lineitem GROUP BY 1), f AS (SELECT s, min(l_orderkey) AS first FROM o GROUP BY 1), c AS (SELECT s, row_number() OVER (ORDER BY first) - 1 AS code FROM f) SELECT l_orderkey, CAST(CASE WHEN (SELECT count(*) FROM c) = 2 THEN code = 1 ELSE CAST(code AS BOOLEAN) END AS INTEGER) AS y FROM o JOIN c USING (s)",
        "target_factorize": f"WITH g AS (SELECT o_orderkey, {_gaps('o_orderkey', 'o_orderpriority')} AS x FROM orders), f AS (SELECT x, min(o_orderkey) AS first FROM g WHERE x IS NOT NULL GROUP BY 1), c AS (SELECT x, row_number() OVER (ORDER BY first) - 1 AS code FROM f) SELECT o_orderkey, CAST(coalesce(code, -1) AS INTEGER) AS y FROM g LEFT JOIN c USING (x)",
        "target_multiclass": "WITH f AS (SELECT o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY 1), c AS (SELECT o_orderpriority, row_number() OVER (ORDER BY first) - 1 AS code FROM f) SELECT o_orderkey, CAST(code AS INTEGER) AS y FROM orders JOIN c USING (o_orderpriority)",
        "target_auto": "WITH f AS (SELECT o_orderstatus, min(o_orderkey) AS first FROM orders GROUP BY 1), c AS (SELECT o_orderstatus, row_number() OVER (ORDER BY first) - 1 AS code FROM f) SELECT 'orders' AS name, o_orderkey AS key, CAST(code AS INTEGER) AS y FROM orders JOIN c USING (o_orderstatus) UNION ALL SELECT 'labels', doc_id, CASE WHEN coalesce(quality, 0) >= 1 THEN 1 ELSE 0 END FROM labels",
        "target_classes": "SELECT count(DISTINCT coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END, '')) AS n_classes FROM orders",
        "stratified_split": f"{_split()} SELECT o_orderkey, y, is_test FROM sp",
        "split_counts": f"{_split()} SELECT y, is_test, count(*) AS n FROM sp GROUP BY ALL",
        "union_of_split": f"SELECT o_orderkey, y FROM ({_STATUS})",
        "kfold_assign": "SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5('0|' || doc_id), doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels",
        "background_sample": "SELECT o_orderkey FROM orders ORDER BY md5('0|' || o_orderkey), o_orderkey LIMIT 100",
        "explain_rows": f"{_split()} SELECT o_orderkey, y, split_pos FROM sp WHERE is_test ORDER BY split_pos, y LIMIT 100",
        "standard_scale": f"{_split()} SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM sp WHERE NOT is_test)) / (SELECT stddev_pop(o_totalprice) FROM sp WHERE NOT is_test), 6) AS totalprice, 0.0::DOUBLE AS flat FROM sp",
        "prepared_matrix": f"""{_split()},
g AS (SELECT o_orderkey, y, is_test, {_gaps('o_orderkey', 'o_totalprice')} AS x, {_gaps('o_orderkey', 'o_orderpriority')} AS v FROM sp),
f AS (SELECT o_orderkey, y, is_test, coalesce(x, (SELECT median(x) FROM g)) AS x, coalesce(v, {_mode('v', 'g')}) AS v FROM g)
SELECT o_orderkey, y, is_test, round((x - (SELECT avg(x) FROM f WHERE NOT is_test)) / (SELECT stddev_pop(x) FROM f WHERE NOT is_test), 6) AS o_totalprice,
{", ".join(f"CASE WHEN v = '{x}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"o_orderpriority_{x}\"" for x in _LEVELS["o_orderpriority"])} FROM f""",
        "header_normalize": f"{_headers()} SELECT * FROM nh",
        "header_ngrams": f"{_headers()}{_GRAMS} SELECT * FROM tf",
        "header_tfidf": f"{_headers()}{_GRAMS}{_WEIGHTS} SELECT model, side, idx, gram, round(w, 6) AS w FROM wt",
        "header_similarity": f"{_headers()}{_GRAMS}{_WEIGHTS}{_SIMILAR} SELECT model, req_idx, user_idx, round(sim, 6) AS sim FROM sm",
        "header_assignment": f"{_headers()}{_GRAMS}{_WEIGHTS}{_SIMILAR}{_ASSIGN} SELECT model, required, header, score FROM mt",
        "header_assignment_orders": f"{_headers(_order_rows())}{_GRAMS}{_WEIGHTS}{_SIMILAR}{_ASSIGN} SELECT required, header, score FROM mt",
        "table_headers": f"{_headers(query=_TABLE_HEADERS)} SELECT * FROM nh",
        "table_header_weights": f"{_headers(query=_TABLE_HEADERS)}{_GRAMS}{_WEIGHTS} SELECT model, side, idx, gram, round(w, 6) AS w FROM wt",
        "table_assignment": f"{_headers(query=_TABLE_HEADERS)}{_GRAMS}{_WEIGHTS}{_SIMILAR}{_ASSIGN}, {_PLACED}",
        "table_embedder": f"{_headers(query=_TABLE_HEADERS)}{_BY_LETTERS}{_ASSIGN}, {_PLACED}",
        "run_images": "SELECT r_name AS name, 'image' AS data_kind, CASE WHEN r_name LIKE 'A%' THEN 'MODEL_07' ELSE 'MODEL_06' END AS model, CASE WHEN r_name LIKE 'A%' THEN 'breast histopathology scan' ELSE 'colon colonoscopy scan' END AS modality, CASE WHEN r_name LIKE 'A%' THEN 'seen in ' || r_name ELSE 'Polyp' END AS disease, 1 AS n_images, 'model_coupled' AS mode, 'image inference is left to the image model' AS note, 'ok,ok,ok,ok,ok,ok,ok' AS stages FROM region",
        "table_selection": f"""{_headers(query=_TABLE_HEADERS)}{_GRAMS}{_WEIGHTS}{_SIMILAR}{_ASSIGN},
q AS (SELECT model, count(*) AS n_required FROM hd WHERE side = 'required' GROUP BY 1),
e AS (SELECT q.model, q.n_required, count(mt.model) AS n_matched FROM q LEFT JOIN mt USING (model) GROUP BY ALL)
SELECT model, CAST(n_required AS INTEGER) AS n_required, CAST(n_matched AS INTEGER) AS n_matched, n_matched = n_required AS eligible,
coalesce(model = (SELECT model FROM e WHERE n_matched = n_required ORDER BY n_matched DESC, model LIMIT 1), false) AS chosen FROM e""",
        "table_registry": f"WITH m AS ({_MODELS}) SELECT model, 'table' AS kind, string_agg(header, ',' ORDER BY o) AS headers, max(CASE WHEN o = n THEN header END) AS output FROM m GROUP BY model",
        "table_modalities": "SELECT DISTINCT source || ' image' AS modality FROM documents WHERE source IS NOT NULL",
        "table_image_match": "SELECT q.modality, min(d.source || '-' || d.lang) AS model FROM (SELECT DISTINCT coalesce(source, 'no') || ' image' AS modality FROM documents UNION SELECT DISTINCT event_type || ' image' FROM events) q LEFT JOIN documents d ON d.source || ' image' = q.modality GROUP BY 1",
        "run_orders": "SELECT 'tabular' AS data_kind, 'ORDERS' AS model, 'o_orderstatus' AS target, CAST((SELECT count(DISTINCT o_orderstatus) FROM orders) AS INTEGER) AS n_classes, 3 AS n_headers, CAST(count(*) - ceil(count(*) * 0.2) AS INTEGER) AS n_train, CAST(ceil(count(*) * 0.2) AS INTEGER) AS n_test, CAST(2 + count(DISTINCT o_orderpriority) AS INTEGER) AS n_features, 'identify:ok,anonymize:ok,features:ok,match:ok,recommend:ok,prepare:ok,infer:ok' AS stages, count(*) - CAST(ceil(count(*) * 0.2) AS BIGINT) + CAST(ceil(count(*) * 0.2) AS BIGINT) AS n_scored FROM orders",
        "model_selection": f"""{_headers()}{_GRAMS}{_WEIGHTS}{_SIMILAR}{_ASSIGN},
q AS (SELECT model, count(*) AS n_required FROM hd WHERE side = 'required' GROUP BY 1),
e AS (SELECT q.model, q.n_required, count(mt.model) AS n_matched FROM q LEFT JOIN mt USING (model) GROUP BY ALL)
SELECT model, CAST(n_required AS INTEGER) AS n_required, CAST(n_matched AS INTEGER) AS n_matched, n_matched = n_required AS eligible,
model = (SELECT model FROM e WHERE n_matched = n_required ORDER BY n_matched DESC, model LIMIT 1) AS chosen FROM e""",
        "registry_scan": _registry(),
        "modality_catalogue": f"SELECT DISTINCT modality FROM ({_registry()}) WHERE kind = 'image'",
        "image_model_match": f"SELECT q.modality, min(r.model) AS model FROM (VALUES ('colon colonoscopy scan'), ('breast histopathology scan'), ('chest x-ray')) AS q(modality) LEFT JOIN ({_registry()}) r ON r.modality = q.modality AND r.kind = 'image' GROUP BY 1",
        "vector_cosine_topk": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(v.e, q.e) AS sim FROM v q JOIN v ON q.vec_id % 50 = 0)
SELECT query_id, vec_id, round(sim, 6) AS sim FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 10""",
        "confusion_matrix": _CONFUSION,
        "classification_metrics": f"""WITH s AS ({_SCORED}), c AS (SELECT avg(CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, sum(CASE WHEN y = 1 AND p = 1 THEN 1 ELSE 0 END) AS tp, sum(p) AS pp, sum(y) AS py FROM s),
r AS (SELECT accuracy, coalesce(tp / nullif(pp, 0), 0) AS precision, coalesce(tp / nullif(py, 0), 0) AS recall FROM c)
SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM r""",
        "macro_metrics": f"""WITH s AS ({_SCORED}), lb AS (SELECT DISTINCT unnest([y, p]) AS v FROM s),
c AS (SELECT v, sum(CASE WHEN y = v AND p = v THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p = v THEN 1 ELSE 0 END) AS pp, sum(CASE WHEN y = v THEN 1 ELSE 0 END) AS py FROM s, lb GROUP BY v),
r AS (SELECT coalesce(tp / nullif(pp, 0), 0) AS precision, coalesce(tp / nullif(py, 0), 0) AS recall FROM c),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r)
SELECT round((SELECT avg(CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0 END) FROM s), 6) AS accuracy, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM f""",
        "roc_auc": f"WITH s AS ({_SCORED}), r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS k FROM s) SELECT round((sum(CASE WHEN y = 1 THEN k END) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * (count(*) - sum(y))), 6) AS roc_auc FROM r",
        "cv_accuracy": f"WITH s AS ({_SCORED}), k AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY md5('0|' || doc_id), doc_id) - 1) % 5 AS fold FROM s), a AS (SELECT fold, avg(CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0 END) AS acc FROM k GROUP BY fold) SELECT round(avg(acc), 6) AS cv_mean, round(stddev_pop(acc), 6) AS cv_std FROM a",
        "linear_shap_top10": f"""WITH x AS ({_NUMBERS}), b AS (SELECT avg(totalprice) AS t, avg(custkey) AS c, avg(month) AS m FROM (SELECT * FROM x ORDER BY md5('0|' || o_orderkey), o_orderkey LIMIT 100)),
e AS (SELECT * FROM x ORDER BY o_orderkey LIMIT 100),
i AS (SELECT 'totalprice' AS feature, avg(abs(0.5 * (totalprice - t))) AS v, 1 AS o FROM e, b UNION ALL SELECT 'custkey', avg(abs(-0.25 * (custkey - c))), 2 FROM e, b UNION ALL SELECT 'month', avg(abs(0.125 * (month - m))), 3 FROM e, b)
SELECT CAST(row_number() OVER (ORDER BY v DESC, o) AS INTEGER) AS rank, feature, round(v, 5) AS importance FROM i""",
        "tree_shap": _tree_shap(),
        "boost_gains": _boost_gains(),
        "run_report": _run_report(),
        "run_without_model": _run_without_model(),
        "command_line": _command_line(),
        "gbt_halves": "SELECT o_orderkey, CAST(month(o_orderdate) > 6 AS INTEGER) AS y, CAST(month(o_orderdate) > 6 AS INTEGER) AS p, month(o_orderdate) > 6 AS above FROM orders",
        "cv_halves": "SELECT learner, count(*) AS n_rows, 1.0::DOUBLE AS mean, 0.0::DOUBLE AS deviation FROM orders, (VALUES ('spark'), ('boosting')) AS t(learner) GROUP BY learner",
        "raw_scores": f"SELECT o_orderkey, round(1 / (1 + exp(-(totalprice - custkey))), 6) AS score, CASE WHEN totalprice - custkey > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS plain FROM ({_NUMBERS})",
        "binarized_values": f"SELECT event_id, CASE WHEN coalesce({_gaps('event_id', 'value')}, 0) >= 1 THEN 1 ELSE 0 END AS from_one, CASE WHEN coalesce(value, 0) >= 50 THEN 1 ELSE 0 END AS from_fifty FROM events",
        "load_csv_lines": "SELECT page_id, url, md5(html) AS html_md5, CAST(length(html) AS INTEGER) AS html_length FROM pages",
        "target_of_files": "WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey % 10 <> 3, o_orderkey DESC) AS place FROM orders), f AS (SELECT o_orderpriority, min(place) AS first FROM o GROUP BY 1), c AS (SELECT o_orderpriority, row_number() OVER (ORDER BY first) - 1 AS code FROM f) SELECT o_orderkey, CAST(code AS INTEGER) AS y FROM o JOIN c USING (o_orderpriority)",
        "predictions_output": f"WITH x AS ({_NUMBERS}), s AS (SELECT o_orderkey, 1 / (1 + exp(-(0.5 * totalprice + -0.25 * custkey + 0.125 * month))) AS score FROM x) SELECT o_orderkey, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS y_pred, round(score, 4) AS y_score FROM s",
    }
    for table in _TABLES:
        out[f"profile_{table}"] = f'SELECT "column", n_rows, n_null, n_unique, avg_len FROM ({_profile(table)})'
        out[f"column_types_{table}"] = _types(table)
    return out
