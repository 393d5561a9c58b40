"""SQL giving the same rows as the registered queries, on views of the same tables."""

from __future__ import annotations

# --- shared views, the SQL of ``plans.views`` --------------------------------------------------

BASE = """
base AS (
  SELECT e.event_id, e.user_id,
    lpad(CAST(e.user_id % 2 AS VARCHAR), 24, '0') AS app_id,
    epoch_us(e.ts) // 1000 AS ts_ms,
    CAST(e.user_id AS VARCHAR) || '-' || strftime(e.ts, '%Y%m%d') AS session,
    CASE WHEN e.event_type IN ('view', 'click') THEN 'start' ELSE 'finish' END AS etype,
    CAST(json_extract(e.props, '$.k') AS INTEGER) AS k,
    strftime(e.ts, '%d') AS day
  FROM events e WHERE e.event_type IN ('view', 'click', 'purchase')
),
ev AS (
  SELECT *, lpad(CAST(k % 3 AS VARCHAR), 24, '0') AS variation,
    CASE WHEN k % 5 = 0 THEN 'Predicted' ELSE 'Random' END AS kind,
    167772160 + user_id * 256 + k AS ip_num
  FROM base
)"""

AB = (
    BASE
    + """,
ab AS (
  SELECT ev.*, CASE WHEN k % 7 <> 0 THEN c.c_mktsegment END AS segment, n.n_name AS nation
  FROM ev LEFT JOIN customer c ON ev.user_id = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""
)

IDENTITY = """concat_ws(';', 'day=' || day, 'nation=' || nation, 'segment=' || segment)"""

IDENTITY_JSON = """'{' || concat_ws(',', '"segment":"' || segment || '"',
  '"nation":"' || nation || '"', '"day":"' || day || '"') || '}'"""

SAMPLE = (
    AB
    + """,
sample AS (
  SELECT s.*, EXISTS (SELECT 1 FROM ev f WHERE f.etype = 'finish' AND f.app_id = s.app_id
                      AND f.session = s.session) AS goal
  FROM (SELECT *, count(*) OVER (PARTITION BY app_id, session) AS n_start,
          row_number() OVER (PARTITION BY app_id, session ORDER BY event_id DESC) AS rn
        FROM ab WHERE etype = 'start') s
  WHERE rn = 1
)"""
)

TWO_APPS = """
two_apps AS (
  SELECT * FROM (VALUES ('000000000000000000000000', 'NoData', CAST(NULL AS BIGINT)),
    ('000000000000000000000001', 'Predicting', 1705000000000)) t(app_id, run_state, predicting_from)
)"""

MANY_APPS = """
many AS (
  SELECT lpad(CAST(c_custkey AS VARCHAR), 24, '0') AS app_id, c_custkey,
    CASE c_custkey % 5 WHEN 0 THEN 'NoData' WHEN 1 THEN 'Predicting' WHEN 2 THEN 'Training'
      WHEN 3 THEN 'Suspended' ELSE 'Loading' END AS run_state,
    CASE WHEN c_custkey % 5 = 1 THEN 1705000000000 + c_custkey END AS predicting_from,
    lpad(CAST(c_nationkey AS VARCHAR), 24, '0') AS v0,
    lpad(CAST(c_nationkey + 1 AS VARCHAR), 24, '0') AS v1,
    lpad(CAST(c_nationkey + c_custkey % 3 AS VARCHAR), 24, '0') AS v2,
    CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS nation_flag,
    CASE WHEN c_custkey % 10 = 1 THEN 'models/' || CAST(c_custkey AS VARCHAR) END AS model_path,
    CASE WHEN c_custkey % 10 = 1 THEN 'tree_regressor' END AS model_type
  FROM customer
),
apps AS (
  SELECT *, '{"variations":[{"value":"first","id":"' || v0 || '"},{"value":"second","id":"' || v1
    || '"},{"value":"third","id":"' || v2
    || '"}],"descriptors":[{"name":"segment","categorical":true},{"name":"nation","categorical":'
    || nation_flag || '}]}' AS config
  FROM many
)"""

VISITS = (
    MANY_APPS
    + """,
visits AS (
  SELECT o_orderkey AS event_id, lpad(CAST(o_custkey AS VARCHAR), 24, '0') AS app_id,
    CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 's' || CAST(o_custkey AS VARCHAR) END AS session,
    lpad(CAST(o_orderkey % 27 AS VARCHAR), 24, '0') AS variation
  FROM orders
),
configured AS (
  SELECT v.*, a.v0, a.v1, a.v2, a.config FROM visits v JOIN apps a ON v.app_id = a.app_id
),
options AS (
  SELECT event_id, app_id, session, 0 AS variation_idx, v0 AS option_id FROM configured
  UNION ALL SELECT event_id, app_id, session, 1, v1 FROM configured
  UNION ALL SELECT event_id, app_id, session, 2, v2 FROM configured
)"""
)

# Bodies as they arrive: what each field holds after the faults put into them.
BODIES = (
    AB
    + """,
sent AS (
  SELECT *, k % 11 = 0 AS malformed,
    CASE WHEN k % 11 <> 1 THEN session END AS s,
    CASE WHEN etype = 'finish' AND k % 11 = 1 THEN NULL
         WHEN etype = 'start' AND k % 11 = 3 THEN NULL ELSE ts_ms END AS t,
    CASE WHEN etype = 'start' AND k % 11 <> 4 THEN {identity} ELSE '' END AS i,
    CASE WHEN etype = 'start' AND k % 11 <> 2 THEN lpad(CAST(k % 3 AS VARCHAR), 24, '0') END AS v
  FROM ab
)""".format(identity=IDENTITY)
)

GEO = """,
ranges AS (
  SELECT 167772160 + n_nationkey * 1200 AS ip_from, 167772160 + n_nationkey * 1200 + 1199 AS ip_to,
    CASE WHEN n_nationkey % 7 <> 0 THEN n_name END AS city, r_name AS country
  FROM nation JOIN region ON n_regionkey = r_regionkey
)"""


def draw(*parts: str) -> str:
    """The md5 number of ``functions.hashing.draw``."""
    text = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def unit(*parts: str) -> str:
    return f"({draw(*parts)} / 4294967296.0::DOUBLE)"


def text_hash(value: str) -> str:
    """The JVM hash of a plain-text value."""
    unsigned = (
        f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split({value}, ''), "
        f"lambda ch: unicode(ch)::BIGINT)), lambda a, c: (a * 31 + c) & 4294967295)"
    )
    return (
        f"(CASE WHEN {unsigned} >= 2147483648 THEN {unsigned} - 4294967296 ELSE {unsigned} END)::DOUBLE"
    )


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"


START_COLUMNS = f"event_id, app_id, ts_ms, session, {IDENTITY} AS identity, variation, kind"
REGISTRY_COLUMNS = "app_id, run_state, predicting_from, config, model_path, model_type"

FEATURES = (
    SAMPLE
    + f""",
hashes AS (
  SELECT v, {text_hash('v')} AS h
  FROM (SELECT segment AS v FROM ab UNION SELECT nation FROM ab UNION SELECT day FROM ab
        UNION SELECT 'None') WHERE v IS NOT NULL
)"""
)


def features_of(rows: str, name: str) -> str:
    """Feature columns of the rows of a known variation."""
    return f""",
{name} AS (
  SELECT r.*, a.h AS f0, b.h AS f1, c.h AS f2, CAST(CAST(r.variation AS BIGINT) AS DOUBLE) AS f3
  FROM {rows} r JOIN hashes a ON a.v = coalesce(r.segment, 'None')
  JOIN hashes b ON b.v = coalesce(r.nation, 'None') JOIN hashes c ON c.v = r.day
  WHERE CAST(r.variation AS BIGINT) < 2
)"""


VECTORS = FEATURES + features_of("sample", "vectors")


def supports_of(rows: str, name: str) -> str:
    return f""",
{name} AS (
  SELECT app_id, 0 AS pos, f0 AS raw FROM {rows} UNION SELECT app_id, 1, f1 FROM {rows}
  UNION SELECT app_id, 2, f2 FROM {rows} UNION SELECT app_id, 3, f3 FROM {rows}
)"""


def codes_of(supports: str, name: str) -> str:
    """Codes of the categorical positions (all but the day) with more than one value."""
    return f""",
{name} AS (
  SELECT * FROM (
    SELECT app_id, pos, raw, CAST(row_number() OVER (PARTITION BY app_id, pos ORDER BY raw) - 1
      AS INTEGER) AS code, count(*) OVER (PARTITION BY app_id, pos) AS arity
    FROM {supports} WHERE pos <> 2)
  WHERE arity > 1
)"""


SUPPORTS = VECTORS + supports_of("vectors", "supports")
CODES = SUPPORTS + codes_of("supports", "codes")


def coded_columns(codes: str, fallback: bool = False) -> str:
    columns = []
    for p in range(4):
        found = f"(SELECT code FROM {codes} m WHERE m.app_id = x.app_id AND m.pos = {p} AND m.raw = x.f{p})"
        drawn = (
            f"{draw('x.app_id', 'x.session', str(p))} % (SELECT max(arity) FROM {codes} m "
            f"WHERE m.app_id = x.app_id AND m.pos = {p})"
        )
        options = [found, drawn, f"x.f{p}"] if fallback else [found, f"x.f{p}"]
        columns.append(f"CAST(coalesce({', '.join(options)}) AS DOUBLE) AS f{p}")
    return ", ".join(columns)


LATEST = """
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY app_id, etype ORDER BY event_id DESC) AS newest
    FROM {rows}) WHERE newest <= {n}"""


SAMPLE_COLUMNS = f"app_id, session, event_id, {IDENTITY} AS identity, variation, n_start, goal"

SCORES = (
    VISITS
    + f""",
scored AS (
  SELECT *, floor({unit('event_id', 'variation_idx')} * 5) / 5 AS score FROM options
)"""
)

KNOWN_IP = "CASE WHEN k % 4 <> 0 THEN ip_num END"

IP_TEXT = (
    "CAST({0} >> 24 & 255 AS VARCHAR) || '.' || CAST({0} >> 16 & 255 AS VARCHAR) || '.' || "
    "CAST({0} >> 8 & 255 AS VARCHAR) || '.' || CAST({0} & 255 AS VARCHAR)"
)


def enriched_identity(address: str, stamp: str, plain: dict[str, str]) -> str:
    """Sorted text of an enriched identity; ``plain`` gives its own values by name."""
    place = lambda name: f"CASE WHEN {address} IS NOT NULL THEN '{name}=' || coalesce({name}, '<unknown>') END"
    ip = f"'ip=' || CASE WHEN {address} IS NOT NULL THEN {IP_TEXT.format(address)} ELSE '0.0.0.0' END"
    return (
        f"concat_ws(';', {place('city')}, {place('country')}, {plain['day']}, {ip}, "
        f"{plain['nation']}, {plain['segment']}, 'userTs=' || CAST({stamp} AS VARCHAR))"
    )


PLAIN = {"day": "'day=' || day", "nation": "'nation=' || nation", "segment": "'segment=' || segment"}

STATUS = """SELECT a.app_id, a.run_state, a.predicting_from,
  count(CASE WHEN e.etype = 'start' THEN 1 END) AS n_start,
  count(CASE WHEN e.etype = 'finish' THEN 1 END) AS n_finish
FROM two_apps a LEFT JOIN ev e ON e.app_id = a.app_id AND e.ts_ms > {since}
GROUP BY a.app_id, a.run_state, a.predicting_from"""

ELIGIBLE = f"""
SELECT * FROM ({STATUS.format(since="coalesce(a.predicting_from, 0)")})
WHERE n_finish >= 20 AND n_start >= 50"""

CONFUSION = """SELECT {by} count(*) AS n,
  count(CASE WHEN y = 1 AND p = 1 THEN 1 END) AS tp,
  count(CASE WHEN y = 0 AND p = 1 THEN 1 END) AS fp,
  count(CASE WHEN y = 1 AND p = 0 THEN 1 END) AS fn FROM {rows} {group}"""

RATES = """SELECT {by} n, tp, fp, fn, (fp + fn) / n::DOUBLE AS error,
  CASE WHEN tp + fp = 0 THEN 'NaN'::DOUBLE ELSE tp / (tp + fp)::DOUBLE END AS precision,
  CASE WHEN tp + fn = 0 THEN 'NaN'::DOUBLE ELSE tp / (tp + fn)::DOUBLE END AS recall FROM ({counts})"""

ACCEPTED = """CASE WHEN command = 'reload' THEN run_state IS NOT NULL
  WHEN command = 'start' THEN coalesce(run_state = 'Suspended', false)
  WHEN command IN ('stop', 'status', 'config') THEN coalesce(run_state <> 'Loading', false)
  WHEN command IN ('predict', 'store', 'dump')
    THEN coalesce(run_state NOT IN ('Loading', 'Suspended'), false)
  ELSE coalesce(run_state NOT IN ('Loading', 'Suspended', 'Training'), false) END"""

RETRAINED = _with(
    BASE + "," + TWO_APPS + f", eligible AS ({ELIGIBLE})",
    """
SELECT a.app_id,
  CASE WHEN e.app_id IS NOT NULL THEN 'Predicting' ELSE a.run_state END AS run_state,
  CASE WHEN e.app_id IS NOT NULL THEN 1707000000000 ELSE a.predicting_from END AS predicting_from,
  CASE WHEN e.app_id IS NOT NULL THEN 'tree_regressor' END AS model_type,
  e.app_id IS NOT NULL AS has_model
FROM two_apps a LEFT JOIN eligible e ON a.app_id = e.app_id""",
)

JUDGED = """,
asked AS (
  SELECT o_orderkey AS command_id, lpad(CAST(o_custkey AS VARCHAR), 24, '0') AS app_id,
    CASE o_orderkey % 9 WHEN 0 THEN 'reload' WHEN 1 THEN 'start' WHEN 2 THEN 'stop' WHEN 3 THEN 'status'
      WHEN 4 THEN 'config' WHEN 5 THEN 'predict' WHEN 6 THEN 'store' WHEN 7 THEN 'dump'
      ELSE 'train' END AS command FROM orders
),
judged AS (
  SELECT q.*, a.run_state AS recorded,
    max(CASE WHEN command = 'start' THEN command_id END) OVER earlier AS last_start,
    max(CASE WHEN command = 'stop' THEN command_id END) OVER earlier AS last_stop
  FROM asked q LEFT JOIN apps a ON q.app_id = a.app_id
  WINDOW earlier AS (PARTITION BY q.app_id ORDER BY command_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
placed AS (
  SELECT *, CASE WHEN recorded IS NULL OR recorded = 'Loading' THEN recorded
    WHEN last_stop IS NOT NULL AND last_start > last_stop THEN 'NoData'
    WHEN last_stop IS NOT NULL THEN 'Suspended'
    WHEN last_start IS NOT NULL AND recorded = 'Suspended' THEN 'NoData'
    ELSE recorded END AS run_state FROM judged
)"""

DRAWN = (
    f"(CASE WHEN {draw('app_id', 'session', "'assign'")} % 2 = 0 THEN '000000000000000000000000' "
    "ELSE '000000000000000000000001' END)"
)

OPTION_SCORES = _with(AB, "SELECT event_id, app_id, 2 AS n_scores, true AS in_range, true AS agree FROM ab")


def fitted(one_tree: bool) -> str:
    """Parts of each app's sample; a single tree's scores sum up to the labels it was fitted on."""
    total = ", CASE WHEN train THEN label_sum END AS score_sum" if one_tree else ""
    return _with(
        VECTORS,
        f"""SELECT app_id, train, n, label_sum, true AS in_range, CASE WHEN train THEN true END AS near{total}
            FROM (SELECT app_id, train, count(*) AS n, count(CASE WHEN goal THEN 1 END)::DOUBLE AS label_sum
                  FROM (SELECT *, {unit('app_id', 'session')} < 0.7 AS train FROM vectors) GROUP BY 1, 2)""",
    )


WHO = "CASE WHEN session = '' THEN CAST(event_id AS VARCHAR) ELSE session END"

ORACLES: dict[str, str] = {
    "scan_start": _with(
        AB,
        f"SELECT {START_COLUMNS} FROM ab WHERE etype = 'start' AND app_id = '000000000000000000000001' AND kind = 'Random'",
    ),
    "scan_finish": _with(
        BASE,
        "SELECT event_id, app_id, ts_ms, session FROM ev WHERE etype = 'finish' AND app_id = '000000000000000000000000'",
    ),
    "registry_lookup": _with(MANY_APPS, f"SELECT {REGISTRY_COLUMNS} FROM apps WHERE c_custkey = 11"),
    "scan_tolerant": _with(
        BODIES,
        """SELECT event_id, app_id, etype AS route, CASE WHEN malformed THEN 'malformed'
             WHEN etype = 'finish' THEN NULL WHEN s IS NULL THEN 'no session'
             WHEN v IS NULL THEN 'no variation' END AS fault FROM sent""",
    ),
    "decode_start_json": _with(
        BODIES,
        """SELECT event_id, app_id, s AS session, coalesce(t, 0) AS ts_ms, i AS identity,
             v AS variation, 'Random' AS kind
           FROM sent WHERE etype = 'start' AND NOT malformed AND s IS NOT NULL AND v IS NOT NULL""",
    ),
    "decode_predict_json": _with(
        BODIES,
        """SELECT event_id, app_id, coalesce(s, '') AS session, coalesce(t, 0) AS ts_ms, i AS identity
           FROM sent WHERE NOT malformed""",
    ),
    "decode_finish_json": _with(
        BODIES,
        """SELECT event_id, app_id, coalesce(s, '') AS session, coalesce(t, 0) AS ts_ms
           FROM sent WHERE NOT malformed AND etype = 'finish'""",
    ),
    "decode_config_json": """
SELECT lpad(CAST(c_custkey AS VARCHAR), 24, '0') AS app_id,
  CASE c_custkey % 9 WHEN 0 THEN 'malformed' WHEN 1 THEN 'no descriptors' WHEN 2 THEN 'no variations'
    WHEN 3 THEN 'no variations' END AS fault,
  CASE WHEN c_custkey % 9 > 3 THEN '{"variations":[{"value":"first","id":"'
    || lpad(CAST(c_nationkey AS VARCHAR), 24, '0') || '"},{"value":"second","id":"'
    || lpad(CAST(c_nationkey + 1 AS VARCHAR), 24, '0')
    || '"}],"descriptors":[{"name":"segment","categorical":'
    || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END || '}]}' END AS config
FROM customer""",
    "encode_json": _with(
        AB,
        f"""SELECT event_id, CASE WHEN etype = 'start' THEN
              '{{"type":"start","session":"' || session || '","timestamp":' || ts_ms || ',"identity":'
              || {IDENTITY_JSON} || ',"variation":"' || variation || '"}}'
            ELSE '{{"type":"finish","session":"' || session || '","timestamp":' || ts_ms || '}}'
            END AS body FROM ab""",
    ),
    "encode_config_json": _with(MANY_APPS, "SELECT app_id, config AS body FROM apps"),
    "encode_status_json": _with(
        BASE + "," + TWO_APPS,
        f"""SELECT app_id, '{{"runState":"' || CASE WHEN run_state = 'Predicting'
              THEN 'Predicting({{ Epoch: #' || predicting_from || ' }})' ELSE run_state END
              || '","events":{{"all":{{"start":' || n_start || ',"finish":' || n_finish || '}}}}}}' AS body
            FROM ({STATUS.format(since='0')})""",
    ),
    "union_sources": _with(BASE, "SELECT event_id, app_id, etype, session FROM ev"),
    "append_start": _with(AB, f"SELECT {START_COLUMNS} FROM ab WHERE etype = 'start'"),
    "append_finish": _with(
        BASE, "SELECT event_id, app_id, ts_ms, session FROM ev WHERE etype = 'finish'"
    ),
    "registry_create": _with(
        MANY_APPS
        + """,
asked AS (
  SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY o_orderkey) AS rn FROM (
    SELECT *, lpad(CAST(o_custkey + (o_orderkey % 3) * 1000000 AS VARCHAR), 24, '0') AS app_id FROM orders)
)""",
        f"""SELECT {REGISTRY_COLUMNS} FROM apps UNION ALL
            SELECT app_id, 'NoData', NULL, '{{"variations":[{{"value":"' || o_orderstatus || '","id":"'
              || lpad(CAST(o_orderkey AS VARCHAR), 24, '0') || '"}}],"descriptors":[{{"name":"'
              || o_orderpriority || '","categorical":'
              || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || '}}]}}', NULL, NULL
            FROM asked WHERE rn = 1 AND app_id NOT IN (SELECT app_id FROM apps)""",
    ),
    "registry_update": _with(
        MANY_APPS
        + """,
changes AS (
  SELECT lpad(CAST(o_custkey * 2 AS VARCHAR), 24, '0') AS app_id,
    max(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END) AS state_key,
    max(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END) AS model_key
  FROM orders GROUP BY 1
)""",
        """SELECT a.app_id, CASE WHEN state_key IS NULL THEN run_state
             WHEN state_key % 2 = 0 THEN 'Training' ELSE 'NoData' END AS run_state,
             CASE WHEN state_key IS NULL OR state_key % 2 = 0 THEN predicting_from END AS predicting_from,
             config, coalesce('models/' || model_key, model_path) AS model_path, model_type
           FROM apps a LEFT JOIN changes c ON a.app_id = c.app_id""",
    ),
    "update_where": _with(
        MANY_APPS,
        """SELECT app_id, CASE WHEN late THEN 'Suspended' ELSE run_state END AS run_state,
             predicting_from, config, CASE WHEN late THEN 'retired' ELSE model_path END AS model_path, model_type
           FROM (SELECT *, coalesce(predicting_from > 1705000000100, false) AS late FROM apps)""",
    ),
    "dump_sample": _with(
        SAMPLE,
        """SELECT coalesce(segment, '') AS segment, coalesce(nation, '') AS nation, day, variation,
             CASE WHEN goal THEN 'true' ELSE 'false' END AS result, app_id
           FROM sample""",
    ),
    "filter_app": _with(
        BASE, "SELECT event_id, app_id, etype FROM ev WHERE app_id = '000000000000000000000001'"
    ),
    "filter_since": _with(BASE, "SELECT event_id, app_id, ts_ms FROM ev WHERE ts_ms > 1705000000000"),
    "split_by_type": _with(
        BASE,
        "SELECT event_id, etype, CASE WHEN etype = 'start' THEN 0 ELSE 1 END AS part FROM ev",
    ),
    "filter_known_variation": _with(
        VISITS,
        "SELECT event_id, app_id, variation FROM configured WHERE variation IN (v0, v1, v2)",
    ),
    "pad_id": """
SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 24, '0') AS short_id,
  repeat('0', greatest(0, 24 - length(c_name || c_mktsegment))) || c_name || c_mktsegment AS long_id
FROM customer""",
    "stamp_server_ts": _with(
        BASE, "SELECT event_id, ts_ms AS client_ts, 1707000000000 AS ts_ms FROM ev"
    ),
    "identity_merge": _with(
        AB,
        """SELECT event_id, concat_ws(';', 'day=' || day, 'k=' || k, 'nation=near ' || nation,
             'segment=' || segment) AS identity FROM ab""",
    ),
    "identity_enrich": _with(
        AB + GEO,
        f"""SELECT event_id, {enriched_identity('ip', 'ts_ms', PLAIN)} AS identity
            FROM (SELECT ab.*, {KNOWN_IP} AS ip FROM ab) x
            LEFT JOIN ranges ON ip BETWEEN ip_from AND ip_to""",
    ),
    "geo_range_join": _with(
        BASE + GEO,
        """SELECT event_id, ip_num, coalesce(city, '<unknown>') AS city,
             coalesce(country, '<unknown>') AS country
           FROM ev LEFT JOIN ranges ON ip_num BETWEEN ip_from AND ip_to""",
    ),
    "identity_project": _with(
        AB,
        "SELECT event_id, coalesce(segment, '') AS segment, coalesce(nation, '') AS nation, '' AS absent FROM ab",
    ),
    "feature_hash": _with(
        AB,
        f"""SELECT event_id, {text_hash("coalesce(segment, 'None')")} AS segment_hash,
              {text_hash("coalesce(nation, 'None')")} AS nation_hash,
              {text_hash("session")} AS session_hash FROM ab""",
    ),
    "feature_vector": _with(
        VECTORS,
        "SELECT app_id, session, f0, f1, f2, f3, CASE WHEN goal THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM vectors",
    ),
    "to_feature_frame": _with(
        FEATURES + features_of("(SELECT * FROM ab WHERE etype = 'start')", "vectors"),
        "SELECT event_id, f0, f1, f2, f3, 4 AS width FROM vectors",
    ),
    "variation_index": _with(
        VISITS,
        """SELECT event_id, CASE variation WHEN v2 THEN 2 WHEN v1 THEN 1 WHEN v0 THEN 0 END
             AS variation_idx FROM configured""",
    ),
    "categorical_positions": _with(
        MANY_APPS,
        """SELECT app_id, 0 AS pos FROM apps UNION ALL SELECT app_id, 2 FROM apps
           UNION ALL SELECT app_id, 1 FROM apps WHERE nation_flag = 'true'""",
    ),
    "deduce_kind": _with(BASE, "SELECT event_id, kind FROM ev"),
    "round_prediction": "SELECT event_id, floor(floor(value) / 2 - 5 + 0.5)::DOUBLE AS predicted FROM events",
    "session_pair_join": _with(SAMPLE, "SELECT app_id, session, event_id, variation, goal FROM sample"),
    "config_join": _with(
        VISITS,
        """SELECT v.event_id, v.app_id, a.config FROM visits v LEFT JOIN apps a ON v.app_id = a.app_id""",
    ),
    "expand_variations": _with(VISITS, "SELECT event_id, variation_idx, option_id FROM options"),
    "count_events": _with(BASE, "SELECT app_id, etype, count(*) AS n_events FROM ev GROUP BY 1, 2"),
    "app_status": _with(
        BASE + "," + TWO_APPS,
        f"SELECT app_id, run_state, n_start, n_finish FROM ({STATUS.format(since='1705000000000')})",
    ),
    "session_sample": _with(SAMPLE, f"SELECT {SAMPLE_COLUMNS} FROM sample"),
    "labelled_sample": _with(SAMPLE, f"SELECT {SAMPLE_COLUMNS} FROM sample"),
    "retrain_eligible": _with(
        BASE + "," + TWO_APPS,
        f"""SELECT app_id, run_state, coalesce(predicting_from, 0) AS epoch, n_start, n_finish
            FROM ({ELIGIBLE})""",
    ),
    "infer_supports": _with(SUPPORTS, "SELECT app_id, pos, raw FROM supports"),
    "support_sizes": _with(SUPPORTS, "SELECT app_id, pos, count(*) AS arity FROM supports GROUP BY 1, 2"),
    "explanatory_features": _with(
        SUPPORTS, "SELECT app_id, pos, count(*) AS arity FROM supports GROUP BY 1, 2 HAVING count(*) > 1"
    ),
    "evaluate_binary": RATES.format(
        by="",
        counts=CONFUSION.format(
            by="", rows="(SELECT quality AS y, toxic AS p FROM labels)", group=""
        ),
    ),
    "evaluate_baseline": _with(
        SAMPLE,
        RATES.format(
            by="app_id,",
            counts=CONFUSION.format(
                by="app_id,",
                rows="(SELECT app_id, CAST(goal AS INTEGER) AS y, 0 AS p FROM sample)",
                group="GROUP BY app_id",
            ),
        ),
    ),
    "latest_start": _with(SAMPLE, "SELECT app_id, session, event_id, variation, kind FROM sample"),
    "latest_n": _with(
        BASE, f"SELECT event_id, app_id, etype, session FROM ({LATEST.format(rows='ev', n=500)})"
    ),
    "argmax_variation": _with(
        SCORES,
        """SELECT app_id, event_id, variation_idx, score FROM (
             SELECT *, row_number() OVER (PARTITION BY app_id, event_id
               ORDER BY score DESC, variation_idx) AS rn FROM scored) WHERE rn = 1""",
    ),
    "union_events": _with(
        BASE,
        """SELECT event_id, app_id, session, CASE WHEN etype = 'start' THEN variation END AS variation, etype
           FROM ev""",
    ),
    "merge_supports": _with(SUPPORTS, "SELECT app_id, pos, raw FROM supports"),
    "train_test_split": _with(
        SAMPLE, f"SELECT app_id, session, goal, {unit('app_id', 'session')} < 0.7 AS train FROM sample"
    ),
    "random_assign": _with(
        VISITS
        + f""",
assigned AS (
  SELECT *, CAST({draw('app_id', WHO, "'assign'")} % 3 AS INTEGER) AS variation_idx FROM configured
)""",
        """SELECT event_id, variation_idx, CASE variation_idx WHEN 0 THEN v0 WHEN 1 THEN v1 ELSE v2 END AS variation,
             CASE variation_idx WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'third' END AS value,
             'Random' AS kind FROM assigned""",
    ),
    "score_jitter": _with(
        SCORES,
        f"""SELECT event_id, variation_idx, round(score
              + ({unit('app_id', 'event_id', 'variation_idx', "'jitter'")} * 2 - 1) * 0.01::DOUBLE, 9) AS score
            FROM scored""",
    ),
    "unseen_fallback": _with(
        VECTORS
        + features_of("(SELECT * FROM ab WHERE etype = 'start' AND ts_ms < 1704153600000)", "early")
        + supports_of("early", "seen")
        + codes_of("seen", "codes"),
        f"SELECT x.app_id, x.session, {coded_columns('codes', True)} FROM vectors x",
    ),
    "category_mapping": _with(CODES, "SELECT app_id, pos, raw, code, arity FROM codes"),
    "remap_sample": _with(
        CODES,
        f"""SELECT x.app_id, x.session, {coded_columns('codes')},
              CASE WHEN x.goal THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM vectors x""",
    ),
    "prepare_sample": _with(
        CODES,
        f"""SELECT x.app_id, x.session, {coded_columns('codes')},
              CASE WHEN x.goal THEN 1.0 ELSE 0.0 END::DOUBLE AS label,
              {unit('x.app_id', 'x.session')} < 0.7 AS train FROM vectors x""",
    ),
    "prepare_sample_own_hash": _with(
        SAMPLE
        + """,
vectors AS (
  SELECT *, coalesce(length(segment), -1)::DOUBLE AS f0, coalesce(length(nation), -1)::DOUBLE AS f1,
    length(day)::DOUBLE AS f2, CAST(CAST(variation AS BIGINT) AS DOUBLE) AS f3
  FROM sample WHERE CAST(variation AS BIGINT) < 2
)"""
        + supports_of("vectors", "supports")
        + codes_of("supports", "codes"),
        f"""SELECT x.app_id, x.session, {coded_columns('codes')},
              CASE WHEN x.goal THEN 1.0 ELSE 0.0 END::DOUBLE AS label,
              {unit('x.app_id', 'x.session')} < 0.7 AS train FROM vectors x""",
    ),
    "train_report": _with(
        VECTORS,
        f"""SELECT app_id, count(*) AS sample_size,
              round(count(CASE WHEN held AND goal THEN 1 END) / count(CASE WHEN held THEN 1 END)::DOUBLE, 9)
                AS baseline_error
            FROM (SELECT *, {unit('app_id', 'session')} >= 0.7 AS held FROM vectors) GROUP BY app_id""",
    ),
    "model_roundtrip": _with(
        VECTORS, "SELECT app_id, count(*) AS n_scored, 0 AS n_different FROM vectors GROUP BY app_id"
    ),
    "fit_dt_regressor": fitted(True),
    "fit_dt_classifier": fitted(True),
    "fit_rf_regressor": fitted(False),
    "fit_rf_classifier": fitted(False),
    "train_and_evaluate": _with(
        VECTORS,
        f"""SELECT app_id, 0 AS trained_at, count(*) AS sample_size,
              round(count(CASE WHEN held AND goal THEN 1 END) / count(CASE WHEN held THEN 1 END)::DOUBLE, 9)
                AS baseline_error, true AS rates_hold
            FROM (SELECT *, {unit('app_id', 'session')} >= 0.7 AS held FROM vectors) GROUP BY app_id""",
    ),
    "score_regression": OPTION_SCORES,
    "score_classification": OPTION_SCORES,
    "choose_variation": _with(
        AB,
        f"""SELECT event_id, app_id, second AS predicted, CASE WHEN NOT second THEN drawn END AS drawn,
              CASE WHEN second THEN true END AS best,
              CASE WHEN NOT second THEN v.value END AS value
            FROM (SELECT *, app_id = '000000000000000000000001' AS second, {DRAWN} AS drawn FROM ab)
            JOIN (VALUES ('000000000000000000000000', 'value 0'), ('000000000000000000000001', 'value 1')) v(id, value)
              ON v.id = drawn""",
    ),
    "predict_and_log": _with(
        AB + GEO,
        f"""SELECT event_id, app_id, 1707000000000 AS ts_ms, session,
              {enriched_identity('ip_num', 'ts_ms', PLAIN)} AS identity,
              CASE WHEN app_id = '000000000000000000000001' THEN 'Predicted' ELSE 'Random' END AS kind,
              CASE WHEN app_id = '000000000000000000000000' THEN {DRAWN} END AS drawn,
              CASE WHEN app_id = '000000000000000000000001' THEN true END AS best
            FROM ab LEFT JOIN ranges ON ip_num BETWEEN ip_from AND ip_to""",
    ),
    "apply_commands": _with(
        MANY_APPS + JUDGED,
        f"""SELECT command_id, app_id, command, run_state, accepted,
              CASE WHEN accepted AND command = 'start' THEN 'NoData'
                WHEN accepted AND command = 'stop' THEN 'Suspended' ELSE run_state END AS new_state
            FROM (SELECT *, {ACCEPTED} AS accepted FROM placed)""",
    ),
    "command_job": _with(
        MANY_APPS + JUDGED + f""",
told AS (
  SELECT command_id, app_id, {ACCEPTED} AS accepted, CASE WHEN command = 'start' THEN 'NoData'
    WHEN command = 'stop' THEN 'Suspended' ELSE run_state END AS new_state FROM placed
),
ends AS (
  SELECT app_id, arg_max(new_state, command_id) AS state FROM told WHERE accepted GROUP BY app_id
)""",
        """SELECT a.app_id, coalesce(e.state, a.run_state) AS run_state,
             CASE WHEN coalesce(e.state, a.run_state) IN ('Predicting', 'Training') THEN predicting_from END
               AS predicting_from, config, model_path, model_type
           FROM apps a LEFT JOIN ends e ON a.app_id = e.app_id""",
    ),
    "recover_registry": _with(
        MANY_APPS,
        """SELECT app_id, CASE WHEN run_state = 'Training' THEN 'NoData' ELSE run_state END AS run_state,
             predicting_from, config, model_path, model_type FROM apps""",
    ),
    "retrain_cycle": RETRAINED,
    "stream_ingest": _with(
        BODIES + GEO + """,
asked AS (
  SELECT * REPLACE (CASE WHEN event_id % 83 = 0 THEN '000000000000000000000003'
      WHEN event_id % 89 = 0 THEN '000000000000000000000002' ELSE app_id END AS app_id,
      CASE WHEN event_id % 97 = 0 THEN 'visit' ELSE etype END AS etype)
  FROM sent
),
told AS (
  SELECT *, CASE WHEN etype = 'visit' THEN 'unknown route' WHEN event_id % 83 = 0 THEN 'app is Suspended'
      WHEN event_id % 89 = 0 THEN 'unknown app' WHEN malformed THEN 'malformed'
      WHEN etype = 'finish' THEN NULL WHEN s IS NULL THEN 'no session'
      WHEN v IS NULL THEN 'no variation' END AS fault
  FROM asked
)""",
        f"""SELECT event_id, app_id, ts_ms, session, identity, variation, kind, etype, fault FROM (
              SELECT event_id, app_id, true_ts + 250 AS ts_ms, s AS session,
                {enriched_identity('ip', 'coalesce(t, 0)', {
                    'day': "CASE WHEN k % 11 <> 4 THEN 'day=' || day END",
                    'nation': "CASE WHEN k % 11 <> 4 THEN 'nation=' || nation END",
                    'segment': "CASE WHEN k % 11 <> 4 THEN 'segment=' || segment END",
                })} AS identity, v AS variation, 'Random' AS kind, 'start' AS etype, fault
              FROM (SELECT *, ts_ms AS true_ts, {KNOWN_IP} AS ip FROM told) x
              LEFT JOIN ranges ON ip BETWEEN ip_from AND ip_to
              WHERE etype = 'start' AND fault IS NULL
              UNION ALL
              SELECT event_id, app_id, ts_ms + 250, coalesce(s, ''), NULL, NULL, NULL, 'finish', NULL
              FROM told WHERE etype = 'finish' AND fault IS NULL
              UNION ALL
              SELECT event_id, app_id, NULL, NULL, NULL, NULL, NULL, etype, fault FROM told
              WHERE fault IS NOT NULL)""",
    ),
    "refused_requests": _with(
        VISITS,
        """SELECT v.event_id, v.app_id, CASE WHEN a.app_id IS NULL THEN 'unknown app' ELSE 'app is ' || a.run_state END AS reason
           FROM visits v LEFT JOIN apps a ON v.app_id = a.app_id
           WHERE a.app_id IS NULL OR a.run_state IN ('Suspended', 'Loading')""",
    ),
    "stream_session_sample": _with(
        SAMPLE, "SELECT app_id, session, event_id, variation, n_start, goal FROM sample"
    ),
    "stream_predict": _with(
        AB + GEO,
        f"""SELECT event_id, app_id, ts_ms + 250 AS ts_ms, session,
              {enriched_identity('ip_num', 'ts_ms', PLAIN)} AS identity,
              CASE WHEN {draw('app_id', 'session', "'assign'")} % 2 = 0 THEN '000000000000000000000000'
                ELSE '000000000000000000000001' END AS variation, 'Random' AS kind
            FROM ab LEFT JOIN ranges ON ip_num BETWEEN ip_from AND ip_to""",
    ),
    "stream_retrain_trigger": RETRAINED,
}

# Decisions by node tables give the same rows as by loaded models.
ORACLES["choose_variation_as_data"] = ORACLES["choose_variation"]
ORACLES["predict_and_log_as_data"] = ORACLES["predict_and_log"]
ORACLES["append_start_compacted"] = ORACLES["append_start"]
