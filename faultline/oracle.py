"""Independent DuckDB SQL for every registered query (the correctness oracle).

The adapters of ``faultline.sources.adapters`` are restated here as CTEs in
DuckDB's dialect (RE2 regexes, ``list_filter`` lambdas, ``md5``), so a check
compares two engines, two regex libraries and two independent spellings of
each operator.  The driver registers the raw tables as views.
"""

from __future__ import annotations

from faultline.functions import normalize as N
from faultline.sources import adapters as A

T_FROM = f"TIMESTAMP '{A.WINDOW_FROM:%Y-%m-%d %H:%M:%S}'"
T_NOW = f"TIMESTAMP '{A.NOW:%Y-%m-%d %H:%M:%S}'"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def norm(expr: str) -> str:
    """T7 in DuckDB: the same ordered rule list, executed by RE2."""
    out = expr
    for pattern, repl in N.rules():
        out = f"regexp_replace({out}, {q(pattern)}, {q(repl)}, 'g')"
    return f"trim({out}, {q(N.TRIM_CHARS)})"


def contains_ci(hay: str, needle: str) -> str:
    up, lo = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"(instr(translate(coalesce({hay}, ''), '{up}', '{lo}'), translate({needle}, '{up}', '{lo}')) > 0)"


STORED_TOKEN = r"regexp_replace(t.key, '([=\\])', '\\\1', 'g') || '=' || t.value"


def has_tag(tags: str, key_sql: str, value_sql: str) -> str:
    return f"(len(list_filter({tags}, lambda t: {STORED_TOKEN} = ({key_sql} || '=' || {value_sql}))) > 0)"


def issue_id(pid: str, fp: str) -> str:
    return f"CAST(('0x' || substr(md5(CAST({pid} AS VARCHAR) || ':' || {fp}), 1, 15)) AS BIGINT)"


def _case(expr: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN {q(k) if isinstance(k, str) else k} THEN {q(v) if isinstance(v, str) else v}"
                     for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def _ev_ctes() -> str:
    level_name = _case("event_type", A.LEVEL_BY_TYPE, "'unknown'")
    big = "CAST(1000000 + (event_id * 7919) % 9000000 AS VARCHAR)"
    at = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
    ip = "'10.0.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(event_id % 256 AS VARCHAR)"
    k = "json_extract_string(props, '$.k')"
    message = (
        f"CASE WHEN event_type = 'error' THEN 'db error id=' || CAST(user_id AS VARCHAR) || ' conn ' || {ip} "
        f"|| ':5432 refused after ' || {big} || ' ms at ' || {at} "
        f"ELSE event_type || ' failed id=' || CAST(user_id AS VARCHAR) || ' after ' || {big} || ' ms at ' "
        f"|| {at} || ' step ' || CAST(CAST({k} AS INTEGER) % 10 AS VARCHAR) END"
    )
    envs = "[" + ", ".join(q(e) for e in A.ENVS) + "]"
    levels = {k2: v for k2, v in __import__("faultline.functions.columns", fromlist=["LEVELS"]).LEVELS.items()}
    level_code = _case("lower(level_name)", levels, "7")

    def kv(key: str, val: str) -> str:
        return f"{{'key': {q(key)}, 'value': CAST({val} AS VARCHAR)}}"

    nonempty = "lambda t: t.value <> ''"
    tags = (
        f"list_filter([{kv('env', 'env')}, {kv('level', 'level_name')}, {kv('release', 'release')}, "
        f"{kv('user', 'user_ref')}], {nonempty}) || list_filter([{kv('k', 'k')}, {kv('os', 'os')}], {nonempty})"
    )
    contexts = (
        f"list_filter([{kv('device.arch', q('amd64'))}, {kv('device.num_cpu', 'CAST(k AS INTEGER) % 8 + 1')}, "
        f"{kv('runtime.name', q('go'))}, {kv('os.name', 'os')}], {nonempty})"
    )
    return f"""
ev_base AS (
  SELECT
    CAST(user_id % 5 + 1 AS INTEGER) AS pid,
    date_trunc('second', ts) AS created_at,
    CAST(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS SMALLINT) AS deleted,
    CAST(90 AS SMALLINT) AS retention_days,
    md5(CAST(event_id AS VARCHAR)) AS event_id,
    {envs}[event_id % 3 + 1] AS env,
    'nordland@1.' || CAST(event_id % 4 AS VARCHAR) || '.0' AS release,
    {ip} AS ipv4,
    '::1' AS ipv6,
    CASE WHEN user_id % 10 = 0 THEN '' ELSE 'id:' || CAST(user_id AS VARCHAR) END AS user_ref,
    CASE WHEN user_id % 10 = 0 THEN '' ELSE 'user' || CAST(user_id AS VARCHAR) || '@example.com' END AS user_email,
    '' AS user_name,
    CASE WHEN user_id % 3 = 0 THEN '' ELSE 'user' || CAST(user_id AS VARCHAR) END AS user_username,
    {level_name} AS level_name,
    {message} AS message,
    {k} AS k,
    CASE WHEN event_id % 3 = 0 THEN 'linux' WHEN event_id % 3 = 1 THEN 'darwin' ELSE '' END AS os
  FROM events
),
ev_fp AS (
  SELECT *, md5(coalesce({norm(norm("coalesce(message, '')"))}, '') || level_name || 'go') AS primary_hash
  FROM ev_base
),
ev AS (
  SELECT pid, created_at, deleted, retention_days, event_id, CAST(1 AS SMALLINT) AS platform, env, release,
         ipv4, ipv6, user_ref, user_email, user_name, user_username, CAST(1 AS SMALLINT) AS sdk_id,
         '0.29.0' AS sdk_version, {tags} AS tags, {contexts} AS contexts, message,
         message || ': (No error message)' AS title, CAST({level_code} AS SMALLINT) AS level,
         CAST(1 AS SMALLINT) AS type, primary_hash, {issue_id('pid', 'primary_hash')} AS gid
  FROM ev_fp
),
live AS (SELECT * FROM ev WHERE deleted = 0),
tagrows AS (SELECT gid, pid, created_at, t.key AS tag, t.value AS value
            FROM (SELECT gid, pid, created_at, unnest(tags) AS t FROM live))"""


def sql(body: str, extra_ctes: str = "") -> str:
    """Prefix a query body with the adapter CTEs (plus optional extra CTEs)."""
    extra = f",\n{extra_ctes.strip()}" if extra_ctes.strip() else ""
    return f"WITH {_ev_ctes().strip()}{extra}\n{body.strip()}"


def tags_text(col: str = "tags") -> str:
    return f"array_to_string(list_transform({col}, lambda kv_: kv_.key || '=' || kv_.value), ',')"


# ---------------------------------------------------------------------------
# Expected ingest results, computed from the generation rule of the raw
# envelopes (not by parsing their text): Spark goes text -> parse -> columns,
# DuckDB goes source columns -> expected values.
# ---------------------------------------------------------------------------
_FRAME_T = 'STRUCT("function" VARCHAR, module VARCHAR, package VARCHAR, abs_path VARCHAR, lineno BIGINT, in_app BOOLEAN)'


def _frame(fn: str, module: str, package: str, path: str, lineno: str, in_app: str) -> str:
    return (f"{{'function': {q(fn)}, 'module': {module}, 'package': {package}, 'abs_path': {q(path)}, "
            f"'lineno': CAST({lineno} AS BIGINT), 'in_app': {in_app}}}")


def module_of(f: str) -> str:
    return f"(CASE WHEN coalesce({f}.module, '') <> '' THEN {f}.module ELSE coalesce({f}.package, '') END)"


def raw_ctes() -> str:
    from faultline.functions.normalize import IGNORED_CULPRIT_MODULES

    level_name = _case("event_type", A.LEVEL_BY_TYPE, "'unknown'")
    big = "CAST(1000000 + (event_id * 7919) % 9000000 AS VARCHAR)"
    at = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
    ip = "'10.0.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(event_id % 256 AS VARCHAR)"
    kx = "json_extract_string(props, '$.k')"
    message = (
        f"CASE WHEN event_type = 'error' THEN 'db error id=' || CAST(user_id AS VARCHAR) || ' conn ' || {ip} "
        f"|| ':5432 refused after ' || {big} || ' ms at ' || {at} "
        f"ELSE event_type || ' failed id=' || CAST(user_id AS VARCHAR) || ' after ' || {big} || ' ms at ' "
        f"|| {at} || ' step ' || CAST(CAST({kx} AS INTEGER) % 10 AS VARCHAR) END"
    )
    empty_frames = f"CAST([] AS {_FRAME_T}[])"
    frames = "[" + ", ".join([
        _frame("main", "'main'", "NULL", "/app/cmd/main.go", "10 + k % 40", "true"),
        _frame("run", "CASE WHEN t = 'signup' THEN '' ELSE 'app/db' END", "'app/pkg'", "/app/db/db.go",
               "100 + i % 9", "(i % 4 <> 3)"),
        _frame("CaptureException", "'github.com/getsentry/sentry-go'", "NULL", "sentry.go", "55", "false"),
    ]) + "]"
    main_exc = ("{'type': CASE WHEN t = 'error' THEN 'DBError' ELSE '' END, "
                "'value': 'query failed id=' || CAST(u AS VARCHAR) || ' at ' || ts_text, 'frames': " + frames + "}")
    no_frames = f"{{'type': '*net.OpError', 'value': 'dial tcp 10.0.0.1:5432: connection refused', 'frames': {empty_frames}}}"
    second = ("{'type': '*errors.errorString', 'value': 'wrapped id=7', 'frames': ["
              + _frame("wrap", "'app/errs'", "NULL", "/app/errs/wrap.go", "31", "true") + "]}")
    blank = f"{{'type': '', 'value': '', 'frames': {empty_frames}}}"
    exc_t = f'STRUCT("type" VARCHAR, "value" VARCHAR, frames {_FRAME_T}[])[]'
    exceptions = (
        f"CAST(CASE WHEN t = 'error' AND i % 4 = 0 THEN [{no_frames}, {main_exc}] "
        f"WHEN t = 'error' AND i % 4 = 2 THEN [{main_exc}, {second}] "
        f"WHEN t IN ('error', 'signup') THEN [{main_exc}] "
        f"WHEN t = 'purchase' AND i % 5 = 0 THEN [{blank}] ELSE [] END AS {exc_t})"
    )
    tf1 = "[" + _frame("handle", "''", "'app/web'", "/app/web/h.go", "20 + k % 5", "true") + ", " + _frame(
        "serve", "'net/http'", "NULL", "/usr/go/net/http/server.go", "2000", "false") + "]"
    tf3 = "[" + _frame("loop", "'app/bg'", "NULL", "/app/bg/loop.go", "7", "true") + "]"
    thread_frames = (f"CAST(CASE WHEN t <> 'click' THEN [] WHEN i % 3 = 1 THEN {tf3} ELSE {tf1} END "
                     f"AS {_FRAME_T}[])")
    envs = "[" + ", ".join(q(e) for e in A.ENVS) + "]"
    ignored = "[" + ", ".join(q(m) for m in IGNORED_CULPRIT_MODULES) + "]"

    def kv(key: str, val: str) -> str:
        return f"{{'key': {q(key)}, 'value': CAST({val} AS VARCHAR)}}"

    tags = (f"list_filter([{kv('env', 'env')}, {kv('level', 'level_name')}, {kv('release', 'release')}, "
            f"{kv('server_name', 'server_name')}, {kv('user', 'user_ref')}, {kv('k', 'k')}, {kv('os', 'os')}], "
            f"lambda x: x.value <> '')")
    contexts = (
        f"list_filter([{kv('user.ip', 'user_ip')}, {kv('device.arch', q('amd64'))}, "
        f"{kv('device.num_cpu', 'k % 8 + 1')}, {kv('runtime.name', q('go'))}, {kv('runtime.version', q('go1.22.1'))}, "
        f"{kv('runtime.go_maxprocs', q('8'))}, {kv('runtime.go_numroutines', 'CASE WHEN k % 20 = 0 THEN NULL ELSE k % 20 END')}, "
        f"{kv('os.name', 'os')}, {kv('extra.attempt', 'k % 3')}, "
        f"{kv('extra.flags', "CASE WHEN k % 2 = 0 THEN '{\"retry\":true}' ELSE '{\"retry\":false}' END")}, "
        f"{kv('extra.note', "'step ' || CAST(k % 10 AS VARCHAR)")}], lambda x: coalesce(x.value, '') <> '')"
    )
    chosen = ("CASE WHEN len(list_filter(e.frames, lambda f: f.in_app)) > 0 THEN list_filter(e.frames, "
              "lambda f: f.in_app) ELSE e.frames END")
    stack_text = (f"array_to_string(list_transform(exceptions, lambda e: e.type || array_to_string(list_transform("
                  f"{chosen}, lambda f: {module_of('f')} || f.function || CAST((f.lineno // 10) * 10 AS VARCHAR)), '') "
                  f"|| {norm(norm('e.value'))}), '')")
    raw_text = (f"array_to_string(list_transform(exceptions, lambda e: array_to_string(list_transform(e.frames, "
                f"lambda f: {module_of('f')} || f.function), '') || e.type), '')")
    last_frames = "coalesce(exceptions[-1].frames, [])"
    keep = f"list_filter(list_reverse({last_frames}), lambda f: NOT list_contains({ignored}, {module_of('f')}))"
    pick = f"coalesce({keep}[1], {last_frames}[1])"
    return f"""
rs AS (
  SELECT event_id AS i, user_id AS u, event_type AS t, ts,
         CAST({kx} AS INTEGER) AS k,
         CAST(user_id % 5 + 1 AS INTEGER) AS pid,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts_text,
         CASE WHEN event_id % 3 = 0 THEN 'linux' WHEN event_id % 3 = 1 THEN 'darwin' ELSE '' END AS os,
         CASE WHEN user_id % 7 = 0 THEN 'rust' ELSE 'go' END AS platform,
         {level_name} AS level_name,
         {message} AS message,
         {envs}[event_id % 3 + 1] AS env,
         'nordland@1.' || CAST(event_id % 4 AS VARCHAR) || '.0' AS release,
         'host-' || CAST(user_id % 4 AS VARCHAR) AS server_name,
         CASE WHEN user_id % 10 = 0 THEN '' ELSE 'id:' || CAST(user_id AS VARCHAR) END AS user_ref,
         '10.1.' || CAST(user_id % 256 AS VARCHAR) || '.1' AS user_ip,
         CASE WHEN event_id % 53 = 0 THEN 'invalid project identifier'
              WHEN event_id % 41 = 0 THEN 'invalid dsn'
              WHEN event_id % 50 = 1 THEN 'premature end of input'
              WHEN event_id % 50 IN (0, 2) THEN 'invalid event body'
              WHEN event_id % 41 = 1 THEN 'project not found'
              WHEN event_id % 89 = 0 THEN 'invalid remote addr'
              ELSE 'ok' END AS status
  FROM events
),
rx AS (
  SELECT *, {exceptions} AS exceptions, {thread_frames} AS thread_frames FROM rs
),
rv AS (
  SELECT i, pid, t, k, ts, status, message, level_name, platform, exceptions, thread_frames, os,
         {tags} AS tags, {contexts} AS contexts,
         CASE WHEN len(exceptions) > 0 AND len(exceptions[1].frames) > 0 THEN md5({stack_text})
              ELSE md5({norm(norm('message'))} || level_name || platform) END AS fingerprint,
         CASE WHEN len(exceptions) > 0 AND len(exceptions[1].frames) > 0 THEN md5({raw_text})
              ELSE md5(message) END AS raw_fingerprint,
         CASE WHEN len(exceptions) = 0 THEN message WHEN exceptions[-1].type <> '' THEN exceptions[-1].type
              WHEN exceptions[-1].value <> '' THEN 'Error' ELSE message END AS error_type,
         CASE WHEN len(exceptions) = 0 THEN '(No error message)' ELSE exceptions[-1].value END AS error_value,
         CASE WHEN len(exceptions) > 0 AND len({last_frames}) > 0
              THEN {module_of(pick)} || ' in ' || {pick}.function ELSE '' END AS view
  FROM rx
)"""


def frames_text(frames: str, in_app: str) -> str:
    return (f"array_to_string(list_transform({frames}, lambda f: f.function || '|' || "
            f"string_split(f.abs_path, '/')[-1] || '|' || CAST(f.lineno AS VARCHAR) || '|' || "
            f"CAST(f.lineno AS VARCHAR) || '|' || {in_app}), ';')")


def rel_ctes() -> str:
    """DuckDB restatement of the relational adapters."""
    now = T_NOW
    return f"""
teams AS (SELECT CAST(r_regionkey + 1 AS INTEGER) AS id, lower(r_name) AS name FROM region),
accounts AS (SELECT c_custkey + 1 AS id, 'user' || CAST(c_custkey + 1 AS VARCHAR) AS username,
                    'user' || CAST(c_custkey + 1 AS VARCHAR) || '@example.com' AS email, c_name AS name FROM customer),
members AS (SELECT c_custkey + 1 AS user_id, CAST(c_nationkey % 5 + 1 AS INTEGER) AS team_id FROM customer
            UNION ALL
            SELECT c_custkey + 1, CAST((c_nationkey % 5 + 1) % 5 + 1 AS INTEGER) FROM customer WHERE c_custkey % 7 = 0),
projects AS (SELECT CAST(s_suppkey + 1 AS INTEGER) AS id, 'project-' || lower(s_name) AS name,
                    'key' || CAST(s_suppkey + 1 AS VARCHAR) AS key, CAST(s_nationkey % 5 + 1 AS INTEGER) AS team_id
             FROM supplier),
comments AS (SELECT conv_id * 100 + turn AS id, ev.gid AS issue_id, (conv_id * 7 + turn) % {A.N_USERS} + 1 AS user_id,
                    {now} - to_hours(CAST(conv_id AS BIGINT)) + to_minutes(CAST(turn AS BIGINT)) AS created_at,
                    text AS content,
                    [conv_id % {A.N_USERS} + 1, (conv_id + turn) % {A.N_USERS} + 1, conv_id % {A.N_USERS} + 1] AS mentions
             FROM conversations JOIN ev ON md5(CAST(conv_id AS VARCHAR)) = ev.event_id),
feed AS (SELECT o_orderkey AS request_id, ev.gid AS issue_id, o_custkey % {A.N_USERS} + 1 AS user_id,
                o_orderkey % {A.N_USERS} + 1 AS assigned_by,
                o_orderdate + to_seconds(CAST(o_orderkey % 86400 AS BIGINT)) AS created_at,
                CASE WHEN o_orderstatus = 'P' THEN 'delete' ELSE 'assign' END AS action
         FROM orders JOIN ev ON md5(CAST(o_orderkey % (SELECT count(*) FROM ev) AS VARCHAR)) = ev.event_id),
alert_rules AS (SELECT CAST(p_partkey + 1 AS INTEGER) AS id, CAST(p_partkey % 5 + 1 AS INTEGER) AS project_id,
                       pr.team_id, 'rule-' || CAST(p_partkey + 1 AS VARCHAR) AS rule_name,
                       CAST((p_partkey * 13) % 40 - 3 AS INTEGER) AS threshold,
                       CAST(p_partkey % 2 + 1 AS INTEGER) AS condition, CAST(p_partkey % 7 + 1 AS INTEGER) AS timeframe,
                       ['Active', 'Inactive', 'Triggered'][p_partkey % 3 + 1] AS status,
                       p_partkey % 2 = 0 AS high_priority,
                       {now} - to_seconds(CAST((p_partkey * 97) % 2592000 AS BIGINT)) AS created_at
                FROM part JOIN projects pr ON pr.id = p_partkey % 5 + 1),
channels AS (SELECT CAST(r_regionkey * 2 + 1 AS INTEGER) AS id, CAST(r_regionkey + 1 AS INTEGER) AS team_id,
                    'webhook' AS channel_type, true AS enabled, {now} - to_days(CAST(1 + r_regionkey AS INTEGER)) AS created_at
             FROM region
             UNION ALL
             SELECT CAST(r_regionkey * 2 + 2 AS INTEGER), CAST(r_regionkey + 1 AS INTEGER), 'email', r_regionkey % 2 = 0,
                    {now} - to_days(CAST(r_regionkey AS INTEGER)) FROM region),
webhook_configs AS (SELECT CAST(r_regionkey * 2 + 1 AS INTEGER) AS channel_id,
                           'https://hooks.example.com/' || lower(r_name) AS url, r_regionkey % 3 <> 0 AS verified
                    FROM region WHERE r_regionkey <> 4),
issues AS (SELECT gid AS id, pid AS project_id, primary_hash AS hash, min(created_at) AS first_seen,
                  max(created_at) AS last_seen, '(No error message)' AS message,
                  arg_max(message, (created_at, event_id)) AS error_type, '' AS view, 3 AS priority,
                  CAST(0 AS BIGINT) AS num_comments
           FROM ev GROUP BY gid, pid, primary_hash)"""


def rel_sql(body: str, more: str = "") -> str:
    extra = rel_ctes() + ("," + more if more.strip() else "")
    return sql(body, extra)


def timeframe_seconds(expr: str) -> str:
    from faultline.functions.columns import TIMEFRAME_SECONDS
    return _case(expr, TIMEFRAME_SECONDS, "3600")


def alert_ctes(now: str) -> str:
    return f"""
r_listed AS (SELECT ar.* FROM alert_rules ar JOIN projects p ON p.id = ar.project_id
             ),
rw AS (SELECT id AS rule_id, project_id, threshold, condition, status, team_id, rule_name, timeframe, high_priority,
              {timeframe_seconds('timeframe')} AS tf, {now} - to_seconds(CAST({timeframe_seconds('timeframe')} AS BIGINT)) AS w_from
       FROM r_listed WHERE status IN ('Active', 'Triggered')),
per AS (SELECT rw.rule_id, e.gid, count(*) AS times_seen, count(DISTINCT nullif(e.user_ref, '')) AS user_count
        FROM live e JOIN rw ON e.pid = rw.project_id AND e.created_at >= rw.w_from AND e.created_at <= {now}
        GROUP BY 1, 2),
act AS (SELECT rw.rule_id, i.id AS gid FROM issues i JOIN rw ON i.project_id = rw.project_id
        AND (i.last_seen BETWEEN rw.w_from AND {now} OR i.first_seen BETWEEN rw.w_from AND {now})),
evaluated AS (
  SELECT rw.rule_id, rw.project_id, rw.status, coalesce(h.hit, false) AS hit,
         CAST(coalesce(h.max_value, 0) AS BIGINT) AS max_value
  FROM rw LEFT JOIN (
    SELECT per.rule_id,
           max(CASE WHEN rw.condition = 2 THEN user_count ELSE times_seen END) AS max_value,
           bool_or(rw.threshold >= 0 AND (CASE WHEN rw.condition = 2 THEN user_count ELSE times_seen END) > rw.threshold) AS hit
    FROM per JOIN act ON act.rule_id = per.rule_id AND act.gid = per.gid JOIN rw ON rw.rule_id = per.rule_id
    GROUP BY per.rule_id) h ON h.rule_id = rw.rule_id),
transitions AS (
  SELECT rule_id, status, hit,
         CASE WHEN status = 'Active' AND hit THEN 'Triggered' WHEN status = 'Triggered' AND NOT hit THEN 'Active'
              ELSE status END AS new_status,
         CASE WHEN status = 'Active' AND hit THEN 'triggered' WHEN status = 'Triggered' AND NOT hit THEN 'resolved'
         END AS transition
  FROM evaluated),
outbox AS (
  SELECT CAST(t.rule_id AS VARCHAR) || ':' || CAST(c.id AS VARCHAR) || ':' || t.transition AS id, t.rule_id,
         c.id AS channel_id, t.transition AS notification_type,
         CASE WHEN c.channel_type <> 'webhook' THEN 'unsupported channel type: ' || c.channel_type
              WHEN w.verified IS NULL THEN 'get webhook config: not found'
              WHEN NOT w.verified THEN 'webhook not verified' END AS error_message
  FROM transitions t JOIN alert_rules ar ON ar.id = t.rule_id
  JOIN channels c ON c.team_id = ar.team_id AND c.enabled
  LEFT JOIN webhook_configs w ON w.channel_id = c.id
  WHERE t.transition IS NOT NULL)"""
