"""DuckDB SQL of the registered queries, written on its own terms: sets, ranges of integers and self joins."""

from __future__ import annotations

from driftledger.plans import adapter
from driftledger.schemas import OBSERVATION

_TABLES = adapter.ctes(obs=adapter.OBSERVATIONS, reg=adapter.REGISTRY, ev=adapter.EVIDENCE, pre=adapter.PREFIXES, rawlog=adapter.COLLECTION_LOG)
_TEXT = "coalesce(indicator_type, '') AS indicator_type, coalesce(indicator, '') AS indicator"

#: Bounds of IPv4 text as integers.
_MACROS = """
octets AS (SELECT x, CASE WHEN contains(x, '/') THEN CAST(split_part(x, '/', 2) AS INT) ELSE 32 END AS len,
    CAST(split_part(split_part(x, '/', 1), '.', 1) AS BIGINT) * 16777216 + CAST(split_part(split_part(x, '/', 1), '.', 2) AS BIGINT) * 65536 + CAST(split_part(split_part(x, '/', 1), '.', 3) AS BIGINT) * 256
    + CAST(split_part(split_part(x, '/', 1), '.', 4) AS BIGINT) AS a
  FROM (SELECT indicator AS x FROM obs WHERE indicator_type IN ('ip', 'cidr') UNION SELECT prefix FROM reg UNION SELECT prefix FROM pre)),
net AS (SELECT x, a AS lo, a + (1::BIGINT << (32 - len)) - 1 AS hi FROM octets)
"""

_SNAP = """
keys AS (SELECT DISTINCT source_name AS source, substr(retrieved_at_utc, 1, 10) AS day, indicator_type, indicator FROM obs),
days AS (SELECT source, day, lag(day) OVER w AS prev, lead(day) OVER w AS nxt FROM (SELECT DISTINCT source, day FROM keys) WINDOW w AS (PARTITION BY source ORDER BY day))
"""

_DAILY = f"""
{_SNAP},
added AS (SELECT d.source, d.day, count(*) FILTER (WHERE p.indicator IS NULL) AS additions FROM days d JOIN keys k ON k.source = d.source AND k.day = d.day
  LEFT JOIN keys p ON p.source = k.source AND p.day = d.prev AND p.indicator_type = k.indicator_type AND p.indicator = k.indicator WHERE d.prev IS NOT NULL GROUP BY ALL),
gone AS (SELECT d.source, d.day, count(*) FILTER (WHERE c.indicator IS NULL) AS removals FROM days d JOIN keys k ON k.source = d.source AND k.day = d.prev
  LEFT JOIN keys c ON c.source = k.source AND c.day = d.day AND c.indicator_type = k.indicator_type AND c.indicator = k.indicator WHERE d.prev IS NOT NULL GROUP BY ALL),
counted AS (SELECT source, day, count(*) AS u, count(*) FILTER (WHERE indicator_type IN ('ip', 'cidr')) AS a, count(*) FILTER (WHERE indicator_type IN ('url', 'domain')) AS n FROM keys GROUP BY ALL),
raws AS (SELECT source_name AS source, substr(retrieved_at_utc, 1, 10) AS day, count(*) AS r FROM obs GROUP BY ALL),
daily AS (SELECT source, day AS snapshot_day, u AS unique_indicators, a AS unique_ips_cidrs, n AS unique_domains_urls, additions, removals, r AS raw_rows FROM counted JOIN raws USING (source, day) LEFT JOIN added USING (source, day) LEFT JOIN gone USING (source, day))
"""

_PERSISTENCE = f"""
{_SNAP},
total AS (SELECT source, count(*) AS n, max(day) AS last FROM days GROUP BY source),
pers AS (SELECT source, indicator_type, indicator, min(day) AS first_seen, max(day) AS last_seen, count(*) AS snapshots_present, any_value(n) AS successful_snapshots,
  round_even(count(*)::DOUBLE / any_value(n), 6) AS persistence_ratio, CASE WHEN max(day) = any_value(last) THEN 'yes' ELSE 'no' END AS right_censored FROM keys JOIN total USING (source) GROUP BY source, indicator_type, indicator)
"""

_LATEST = """
heads AS (SELECT source_name, substr(retrieved_at_utc, 1, 10) AS day, snapshot_id, max(retrieved_at_utc) AS seen, any_value(source_path) AS source_path, any_value(sha256) AS sha256 FROM obs GROUP BY ALL),
latest AS (SELECT * FROM heads QUALIFY row_number() OVER (PARTITION BY source_name, day ORDER BY seen DESC, snapshot_id DESC) = 1),
lkeys AS (SELECT DISTINCT o.source_name, l.day, o.indicator_type, o.indicator FROM obs o JOIN latest l ON o.snapshot_id = l.snapshot_id),
lcount AS (SELECT source_name, day, count(*) AS n FROM lkeys GROUP BY ALL)
"""

_P, _C = "'2024-01-13'", "'2024-01-14'"
_COMPARE = f"""
{_LATEST},
srcs AS (SELECT DISTINCT source_name AS source FROM obs),
p AS (SELECT * FROM latest WHERE day = {_P}), c AS (SELECT * FROM latest WHERE day = {_C}),
kinds AS (SELECT DISTINCT indicator_type FROM lkeys WHERE day IN ({_P}, {_C})),
pk AS (SELECT source_name AS source, indicator_type, indicator FROM lkeys WHERE day = {_P}), ck AS (SELECT source_name AS source, indicator_type, indicator FROM lkeys WHERE day = {_C}),
both_sides AS (SELECT coalesce(pk.source, ck.source) AS source, coalesce(pk.indicator_type, ck.indicator_type) AS indicator_type, coalesce(pk.indicator, ck.indicator) AS indicator, pk.source IS NOT NULL AS hp, ck.source IS NOT NULL AS hc
  FROM pk FULL JOIN ck ON pk.source = ck.source AND pk.indicator_type = ck.indicator_type AND pk.indicator = ck.indicator),
n AS (SELECT source, indicator_type, count(*) FILTER (WHERE hp) AS np, count(*) FILTER (WHERE hc) AS nc, count(*) FILTER (WHERE hp AND hc) AS nb FROM both_sides GROUP BY ALL),
grid AS (SELECT s.source, k.indicator_type, p.snapshot_id AS ps, c.snapshot_id AS cs, p.seen AS pt, c.seen AS ct, coalesce(np, 0) AS np, coalesce(nc, 0) AS nc, coalesce(nb, 0) AS nb
  FROM srcs s CROSS JOIN kinds k LEFT JOIN p ON p.source_name = s.source LEFT JOIN c ON c.source_name = s.source LEFT JOIN n ON n.source = s.source AND n.indicator_type = k.indicator_type),
two AS (SELECT source, indicator_type, {_P} AS previous_day, {_C} AS current_day, coalesce(ps, '') AS previous_snapshot_id, coalesce(cs, '') AS current_snapshot_id,
  CASE WHEN ps IS NULL THEN 'missing' ELSE 'selected' END AS previous_snapshot_status, CASE WHEN cs IS NULL THEN 'missing' ELSE 'selected' END AS current_snapshot_status,
  coalesce(pt, '') AS previous_retrieved_at_utc, coalesce(ct, '') AS current_retrieved_at_utc, CASE WHEN ps IS NOT NULL THEN np END AS previous_count, CASE WHEN cs IS NOT NULL THEN nc END AS current_count,
  CASE WHEN ps IS NOT NULL AND cs IS NOT NULL THEN nc - nb END AS added_count, CASE WHEN ps IS NOT NULL AND cs IS NOT NULL THEN np - nb END AS removed_count, CASE WHEN ps IS NOT NULL AND cs IS NOT NULL THEN nb END AS unchanged_count,
  CASE WHEN ps IS NOT NULL AND cs IS NOT NULL THEN nc - np END AS net_change, CASE WHEN ps IS NOT NULL AND cs IS NOT NULL AND np > 0 THEN round_even(100.0::DOUBLE * (nc - np) / np, 4) END AS percent_change,
  1 AS calendar_gap_days, 'yes' AS consecutive_calendar_days, CASE WHEN ps IS NULL THEN 'missing_previous_snapshot' WHEN cs IS NULL THEN 'missing_current_snapshot' ELSE 'compared' END AS comparison_status FROM grid)
"""

_EVIDENCE = f"""
{_MACROS},
k AS (SELECT DISTINCT source_name, indicator_type, indicator FROM obs),
told AS (SELECT DISTINCT lower(trim(indicator)) AS i, coalesce(nullif(signal, ''), 'unspecified') AS sig, upper(trim(country)) AS cc, evidence_source AS src FROM ev WHERE upper(trim(country)) NOT IN ('', 'UNKNOWN', 'N/A', 'NA')),
sig AS (
  SELECT k.*, sig || ' (' || src || ')' AS s, cc = 'DK' AS own, sig || ':' || cc || '/' || src AS note FROM k JOIN told ON lower(k.indicator) = i
  UNION SELECT k.*, 'allocation-prefix (' || e || ')', true, 'allocation-prefix:DK/' || e FROM k JOIN net a ON a.x = k.indicator JOIN net b ON a.lo <= b.hi AND b.lo <= a.hi
    JOIN (SELECT prefix, coalesce(nullif(evidence_source, ''), 'prefix-register') AS e FROM pre) q ON q.prefix = b.x WHERE k.indicator_type IN ('ip', 'cidr')),
agg AS (SELECT source_name, indicator_type, indicator, count(DISTINCT s) FILTER (WHERE own) AS o, count(DISTINCT s) FILTER (WHERE NOT own) AS x, array_to_string(list_sort(list(DISTINCT note)), '; ') AS notes FROM sig GROUP BY ALL),
classes AS (SELECT k.*, CASE WHEN coalesce(o, 0) > 0 AND coalesce(x, 0) > 0 THEN 'Conflicting' WHEN o >= 2 THEN 'DK-supported' WHEN o = 1 THEN 'DK-weak' ELSE 'Unknown' END AS country_class,
  coalesce(o, 0) AS danish_signal_count, coalesce(x, 0) AS non_danish_signal_count, coalesce(notes, '') AS evidence_notes FROM k LEFT JOIN agg USING (source_name, indicator_type, indicator))
"""

_SELECT = """
snap AS (SELECT source_name, substr(retrieved_at_utc, 1, 10) AS day, snapshot_id, any_value(retrieved_at_utc) AS seen, any_value(sha256) AS sha, any_value(source_path) AS path, count(*) AS input_rows, count(DISTINCT indicator_type || '|' || indicator) AS unique_indicators FROM obs GROUP BY ALL),
good_log AS (SELECT source, retrieved_at_utc AS seen, substr(retrieved_at_utc, 1, 10) AS day, sha256 FROM rawlog WHERE lower(status) = 'ok' AND http_status = '200'),
unseen AS (SELECT * FROM good_log g WHERE NOT EXISTS (SELECT 1 FROM snap s WHERE s.source_name = g.source AND s.seen = g.seen AND s.sha = g.sha256)),
top AS (SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY source_name, day ORDER BY seen DESC, snapshot_id DESC) = 1),
chosen AS (SELECT t.*, CASE WHEN EXISTS (SELECT 1 FROM unseen u WHERE u.source = t.source_name AND u.day = t.day AND u.seen >= t.seen) THEN 'newer_download_not_normalized' ELSE '' END AS blocked FROM top t)
"""

_STUDY = f"""
{_MACROS},
{_SELECT},
cal AS (SELECT CAST(d AS DATE) AS day FROM range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY) t(d)),
srcs AS (SELECT DISTINCT source_name AS source FROM obs),
evd AS (SELECT DISTINCT day FROM reg),
usable AS (SELECT source_name AS source, CAST(day AS DATE) AS day, CAST(day AS DATE) IN (SELECT day FROM evd) AS evidence FROM chosen WHERE blocked = ''),
skeys AS (SELECT DISTINCT u.day, u.source, o.indicator_type, o.indicator FROM obs o JOIN chosen c ON o.snapshot_id = c.snapshot_id AND c.blocked = '' JOIN usable u ON u.source = c.source_name AND u.day = CAST(c.day AS DATE)),
ranges AS (SELECT day, lo, hi FROM reg JOIN net ON net.x = reg.prefix),
marked AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY lo, hi) AS run FROM (SELECT *, max(hi) OVER (PARTITION BY day ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ranges)),
merged AS (SELECT day, min(lo) AS lo, max(hi) AS hi FROM marked GROUP BY day, run),
hit AS (SELECT k.day, k.source, k.indicator_type, k.indicator, greatest(n.lo, m.lo) AS lo, least(n.hi, m.hi) AS hi FROM skeys k JOIN net n ON n.x = k.indicator JOIN merged m ON m.day = k.day AND m.lo <= n.hi AND m.hi >= n.lo WHERE k.indicator_type IN ('ip', 'cidr')),
cls AS (SELECT k.day, k.source, k.indicator_type, k.indicator, u.evidence, n.hi - n.lo + 1 AS size, coalesce((SELECT sum(h.hi - h.lo + 1) FROM hit h WHERE h.day = k.day AND h.source = k.source AND h.indicator_type = k.indicator_type AND h.indicator = k.indicator), 0)::BIGINT AS got
  FROM skeys k JOIN net n ON n.x = k.indicator JOIN usable u ON u.day = k.day AND u.source = k.source WHERE k.indicator_type IN ('ip', 'cidr')),
members AS (SELECT day, source, indicator_type, indicator, CASE WHEN NOT evidence THEN 'UNKNOWN_EVIDENCE' WHEN got = size THEN 'DK_FULL' WHEN got > 0 THEN 'DK_PARTIAL' ELSE 'NO_DK_MATCH' END AS label, CASE WHEN evidence THEN got END AS matched FROM cls),
fl AS (SELECT day, source, indicator_type, indicator, label = 'DK_FULL' AS f, label IN ('DK_FULL', 'DK_PARTIAL') AS a FROM members),
grid AS (SELECT day, source FROM cal CROSS JOIN srcs)
"""

_LEVELS = "lv AS (SELECT unnest(range(0, 33)) AS k)"
_CIDR = "(w // 16777216) || '.' || (w // 65536 % 256) || '.' || (w // 256 % 256) || '.' || (w % 256) || '/' || (32 - k)"


def _least_list(ranges: str, keys: str = "day") -> str:
    """Aligned blocks that fit into a range and whose enclosing block does not."""
    # a block whose enclosing one does not fit lies next to one of the ends
    return f"""whole AS (SELECT {keys}, lo, hi, k, (lo + (1::BIGINT << k) - 1) // (1::BIGINT << k) AS x, (hi + 1) // (1::BIGINT << k) AS y FROM ({ranges}) CROSS JOIN lv),
piece AS (SELECT DISTINCT {keys}, lo, hi, k, b FROM (SELECT *, unnest([x, x + 1, y - 1, y - 2]) AS b FROM whole) WHERE b >= x AND b < y),
least_list AS (SELECT {keys}, k, b * (1::BIGINT << k) AS w FROM piece WHERE NOT ((b // 2) * (2::BIGINT << k) >= lo AND (b // 2 + 1) * (2::BIGINT << k) - 1 <= hi))"""


#: Single addresses that a source covers in scope on a day: small data only, where counting them is the plainest check.
_HOSTS = "hosts AS (SELECT DISTINCT day, source, unnest(range(lo, hi + 1)) AS h FROM hit)"

_DAILY_STUDY = f"""{_HOSTS},
sdaily AS (SELECT CAST(g.day AS VARCHAR) AS day, g.source, CASE WHEN u.day IS NULL THEN 'missing_or_blocked' ELSE 'usable' END AS status, CASE WHEN u.day IS NOT NULL THEN coalesce(n_all, 0) END AS global_ip_cidr,
  CASE WHEN u.evidence THEN coalesce(nf, 0) END AS "full", CASE WHEN u.evidence THEN coalesce(np, 0) END AS partial, CASE WHEN u.evidence THEN coalesce(nf, 0) + coalesce(np, 0) END AS any_match, CASE WHEN u.evidence THEN coalesce(nn, 0) END AS no_match,
  CASE WHEN u.day IS NOT NULL THEN coalesce(nu, 0) END AS unknown, CASE WHEN u.day IS NOT NULL THEN coalesce(o, 0) END AS non_ip_entries, CASE WHEN u.evidence THEN coalesce(hh, 0) END AS ipv4_addresses, CASE WHEN u.evidence THEN 0::BIGINT END AS ipv6_addresses,
  CASE WHEN coalesce(n_all, 0) > 0 THEN CASE WHEN u.evidence THEN 100 ELSE 0 END END AS classification_coverage_pct
  FROM grid g LEFT JOIN usable u ON u.day = g.day AND u.source = g.source
  LEFT JOIN (SELECT day, source, count(*) AS n_all, count(*) FILTER (WHERE label = 'DK_FULL') AS nf, count(*) FILTER (WHERE label = 'DK_PARTIAL') AS np, count(*) FILTER (WHERE label = 'NO_DK_MATCH') AS nn, count(*) FILTER (WHERE label = 'UNKNOWN_EVIDENCE') AS nu FROM members GROUP BY ALL) m ON m.day = g.day AND m.source = g.source
  LEFT JOIN (SELECT day, source, count(*) AS o FROM skeys WHERE indicator_type NOT IN ('ip', 'cidr') GROUP BY ALL) x ON x.day = g.day AND x.source = g.source
  LEFT JOIN (SELECT day, source, count(*) AS hh FROM hosts GROUP BY ALL) h ON h.day = g.day AND h.source = g.source)"""


def _scoped(pairs: str) -> str:
    """Comparison rows of pairs(previous_date, current_date) in the three scopes, by set algebra on keys."""
    parts = []
    for name, flag, known in (("GLOBAL_IP_CIDR", "true", "true"), ("DK_FULL", "f", "evidence"), ("DK_ANY_MATCH", "a", "evidence")):
        parts.append(f"SELECT '{name}' AS scope, day, source, indicator_type, indicator, {flag} AS inside FROM fl")
    known = "CASE WHEN scope = 'GLOBAL_IP_CIDR' THEN x.day IS NOT NULL AND y.day IS NOT NULL ELSE coalesce(x.evidence, false) AND coalesce(y.evidence, false) END"
    return f"""
pairs AS ({pairs}),
scoped AS ({" UNION ALL ".join(parts)}),
sides AS (SELECT previous_date, current_date_, scope, source, indicator_type, indicator, bool_or(day = previous_date) AS px, bool_or(day = current_date_) AS py, coalesce(bool_or(inside) FILTER (WHERE day = previous_date), false) AS x, coalesce(bool_or(inside) FILTER (WHERE day = current_date_), false) AS y
  FROM pairs JOIN scoped ON day IN (previous_date, current_date_) GROUP BY ALL),
tally AS (SELECT previous_date, current_date_, scope, source, count(*) FILTER (WHERE x) AS b, count(*) FILTER (WHERE y) AS c, count(*) FILTER (WHERE y AND NOT x) AS ad, count(*) FILTER (WHERE x AND NOT y) AS re, count(*) FILTER (WHERE x AND y) AS un, count(*) FILTER (WHERE y AND NOT x AND NOT px) AS fa, count(*) FILTER (WHERE x AND NOT y AND NOT py) AS fr,
  count(*) FILTER (WHERE y AND NOT x AND px) AS en, count(*) FILTER (WHERE x AND NOT y AND py) AS le FROM sides GROUP BY ALL),
framed AS (SELECT p.previous_date, p.current_date_, s.source, sc.scope, {known} AS ok FROM pairs p CROSS JOIN srcs s CROSS JOIN (SELECT unnest(['GLOBAL_IP_CIDR', 'DK_FULL', 'DK_ANY_MATCH']) AS scope) sc
  LEFT JOIN usable x ON x.source = s.source AND x.day = p.previous_date LEFT JOIN usable y ON y.source = s.source AND y.day = p.current_date_),
compared AS (SELECT CAST(f.previous_date AS VARCHAR) AS previous_date, CAST(f.current_date_ AS VARCHAR) AS current_date, f.source, datediff('day', f.previous_date, f.current_date_)::INT AS calendar_gap_days, f.scope, CASE WHEN ok THEN 'compared' ELSE 'unknown_missing_input' END AS status,
  CASE WHEN ok THEN coalesce(b, 0) END AS previous_count, CASE WHEN ok THEN coalesce(c, 0) END AS current_count, CASE WHEN ok THEN coalesce(ad, 0) END AS added_count, CASE WHEN ok THEN coalesce(re, 0) END AS removed_count, CASE WHEN ok THEN coalesce(un, 0) END AS unchanged_count,
  CASE WHEN ok THEN coalesce(c, 0) - coalesce(b, 0) END AS net_change, CASE WHEN ok AND b > 0 THEN round_even(100.0::DOUBLE * (c - b) / b, 4) END AS percent_change, CASE WHEN ok AND b + c - un > 0 THEN round_even(un::DOUBLE / (b + c - un), 6) END AS jaccard,
  CASE WHEN ok THEN coalesce(fa, 0) END AS feed_added, CASE WHEN ok THEN coalesce(fr, 0) END AS feed_removed, CASE WHEN ok THEN coalesce(en, 0) END AS registry_scope_entered, CASE WHEN ok THEN coalesce(le, 0) END AS registry_scope_left
  FROM framed f LEFT JOIN tally t ON t.previous_date = f.previous_date AND t.current_date_ = f.current_date_ AND t.scope = f.scope AND t.source = f.source)"""


_ADJACENT = _scoped("SELECT day AS previous_date, CAST(day + INTERVAL 1 DAY AS DATE) AS current_date_ FROM cal WHERE day < DATE '2024-01-30'")
_ALL_PAIRS = _scoped("SELECT a.day AS previous_date, b.day AS current_date_ FROM (SELECT DISTINCT day FROM usable) a JOIN (SELECT DISTINCT day FROM usable) b ON a.day < b.day")

_ISSUES = f"""{_DAILY_STUDY},{_ADJACENT},
issues AS (
  SELECT 'ERROR' AS severity, 'source_day_blocked' AS code, day AS date, source_name AS source FROM chosen WHERE blocked <> ''
  UNION ALL SELECT 'WARN', 'raw_file_not_found', day, source_name FROM chosen
  UNION ALL SELECT 'WARN', 'source_day_unavailable', day, source FROM sdaily WHERE status <> 'usable'
  UNION ALL SELECT 'WARN', 'large_count_change_review', current_date, source FROM compared WHERE scope = 'GLOBAL_IP_CIDR' AND abs(percent_change) >= 40
  UNION ALL SELECT 'WARN', 'download_not_in_normalized_input', day, source FROM unseen
  UNION ALL SELECT 'WARN', 'collection_attempt_not_successful', substr(retrieved_at_utc, 1, 10), source FROM rawlog WHERE NOT (lower(status) = 'ok' AND http_status = '200'))"""

#: Refused registry responses, by the rule of their making.
EVIDENCE = """
dates AS (SELECT CAST(day AS VARCHAR) AS d, day(day) AS n, count(DISTINCT prefix) AS c FROM reg GROUP BY day),
told AS (SELECT *, CASE WHEN n % 12 = 10 THEN 'response file is missing' WHEN n % 9 = 7 THEN 'response digest differs' WHEN n % 13 = 11 THEN 'metadata of another country' WHEN n % 6 = 2 THEN 'response is not successful'
  WHEN n % 8 = 5 THEN 'query date differs from the day' WHEN n % 10 = 6 THEN 'another country' WHEN n % 7 = 3 THEN 'both address families need networks' WHEN n % 11 = 4 THEN 'a network is not valid' ELSE '' END AS problem,
  '/lake/registry/' || d || '_v2.meta.json' AS meta FROM dates)
"""

_COMPLETE = "complete AS (SELECT day FROM usable WHERE evidence GROUP BY day HAVING count(DISTINCT source) = (SELECT count(*) FROM srcs))"


def _q(parts: str, select: str) -> str:
    return f"WITH {_TABLES}{', ' + parts if parts else ''} {select}"


SQL: dict[str, str] = {
    "a1_daily_summary": _q(_DAILY, "SELECT * FROM daily"),
    "a2_persistence": _q(_PERSISTENCE, "SELECT * FROM pers"),
    "a3_source_overlap": _q(
        "s AS (SELECT DISTINCT source_name AS source, indicator_type, indicator FROM obs), n AS (SELECT source, indicator_type, count(*) AS n FROM s GROUP BY ALL), c AS (SELECT a.source AS source_a, b.source AS source_b, a.indicator_type, count(*) AS c FROM s a JOIN s b ON a.indicator_type = b.indicator_type AND a.indicator = b.indicator AND a.source < b.source GROUP BY ALL)",
        'SELECT x.source AS source_a, y.source AS source_b, x.indicator_type, coalesce(c, 0) AS "intersection", x.n + y.n - coalesce(c, 0) AS "union", round_even(coalesce(c, 0)::DOUBLE / (x.n + y.n - coalesce(c, 0)), 6) AS jaccard FROM n x JOIN n y ON x.indicator_type = y.indicator_type AND x.source < y.source LEFT JOIN c ON source_a = x.source AND source_b = y.source AND c.indicator_type = x.indicator_type',
    ),
    "a4_snapshot_index": _q(_SELECT, "SELECT source_name, day, snapshot_id, input_rows, unique_indicators, input_rows - unique_indicators AS duplicate_rows, 0::BIGINT AS invalid_rows, 0::BIGINT AS conflicts FROM snap"),
    "w3_selected_snapshots": _q(_SELECT, "SELECT source_name, day, snapshot_id, blocked FROM chosen"),
    "w2_latest_snapshot": _q(_LATEST, "SELECT source_name, day, snapshot_id, seen AS retrieved_at_utc, sha256, n AS indicator_count FROM latest JOIN lcount USING (source_name, day)"),
    "a5_two_day_summary": _q(_COMPARE, "SELECT * FROM two"),
    "a14_changes_by_source": _q(_COMPARE, "SELECT source, sum(added_count)::BIGINT AS added, sum(removed_count)::BIGINT AS removed FROM two WHERE added_count IS NOT NULL GROUP BY source"),
    "j5_two_day_changes": _q(
        _COMPARE,
        f"SELECT b.source, indicator_type, indicator, CASE WHEN hc THEN 'added' ELSE 'removed' END AS change, {_P} AS previous_day, {_C} AS current_day, p.snapshot_id AS previous_snapshot_id, c.snapshot_id AS current_snapshot_id, "
        "CASE WHEN hp THEN p.seen ELSE '' END AS previous_retrieved_at_utc, CASE WHEN hc THEN c.seen ELSE '' END AS current_retrieved_at_utc, CASE WHEN hp THEN p.source_path ELSE '' END AS previous_source_path, CASE WHEN hc THEN c.source_path ELSE '' END AS current_source_path, "
        "CASE WHEN hp THEN p.sha256 ELSE '' END AS previous_sha256, CASE WHEN hc THEN c.sha256 ELSE '' END AS current_sha256 FROM both_sides b JOIN p ON p.source_name = b.source JOIN c ON c.source_name = b.source WHERE hp <> hc",
    ),
    "d2_comparison_index": _q(
        _COMPARE,
        " UNION ALL ".join(
            f"SELECT '{role}' AS role, s.source, {day} AS snapshot_day, CASE WHEN t.snapshot_id IS NULL THEN 'missing' ELSE 'selected' END AS status, coalesce(t.snapshot_id, '') AS snapshot_id, coalesce(t.seen, '') AS retrieved_at_utc, coalesce(t.source_path, '') AS source_path, coalesce(t.sha256, '') AS sha256, coalesce(n, 0) AS indicator_count FROM srcs s LEFT JOIN {t} t ON t.source_name = s.source LEFT JOIN lcount l ON l.source_name = s.source AND l.day = t.day"
            for role, day, t in (("previous", _P, "p"), ("current", _C, "c"))
        ),
    ),
    "a6_evidence_classes": _q(_EVIDENCE, "SELECT * FROM classes"),
    "m3_labels_by_source": _q(
        _EVIDENCE,
        "SELECT source_name, country_class, count(*) AS n, any_value(t.indicator_type) AS commonest_type FROM classes JOIN (SELECT source_name, indicator_type FROM (SELECT source_name, indicator_type, count(*) AS c FROM classes GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY c DESC, indicator_type) = 1) t USING (source_name) GROUP BY source_name, country_class",
    ),
    "m6_candidates": _q(_EVIDENCE, "SELECT source_name, count(*) FILTER (WHERE country_class IN ('DK-supported', 'DK-weak')) AS candidates, count(*) AS n_keys FROM classes GROUP BY source_name"),
    "d5_registry_classes": _q(_STUDY, "SELECT CAST(day AS VARCHAR) AS day, source, indicator_type, indicator, label, matched FROM members"),
    "a7_label_counts": _q(
        _STUDY, "SELECT CAST(day AS VARCHAR) AS day, source, label, count(*) AS n FROM (SELECT day, source, label FROM members UNION ALL SELECT day, source, 'NOT_IP_IN_SCOPE' FROM skeys WHERE indicator_type NOT IN ('ip', 'cidr')) GROUP BY ALL"
    ),
    "a8_study_daily": _q(f"{_STUDY},{_DAILY_STUDY}", "SELECT * FROM sdaily"),
    "d3_scoped_comparison": _q(f"{_STUDY},{_ADJACENT}", "SELECT * FROM compared"),
    "j13_all_pairs": _q(f"{_STUDY},{_ALL_PAIRS}", "SELECT * FROM compared"),
    "f9_first_and_last": _q(f"{_STUDY},{_ALL_PAIRS}", "SELECT * FROM compared WHERE previous_date = '2024-01-01' AND current_date = '2024-01-30'"),
    "f8_large_changes": _q(f"{_STUDY},{_ADJACENT}", "SELECT source, previous_date, current_date, percent_change FROM compared WHERE scope = 'GLOBAL_IP_CIDR' AND abs(percent_change) >= 40"),
    "d4_scope_changes": _q(
        f"{_STUDY},{_ADJACENT}",
        "SELECT CAST(s.previous_date AS VARCHAR) AS previous_date, CAST(s.current_date_ AS VARCHAR) AS current_date, s.source, 1 AS calendar_gap_days, indicator_type, indicator, CASE WHEN y THEN 'added' ELSE 'removed' END AS change, "
        "CASE WHEN px AND py THEN 'registry_scope_changed' ELSE 'feed_membership_changed' END AS cause FROM sides s JOIN framed f ON f.previous_date = s.previous_date AND f.current_date_ = s.current_date_ AND f.source = s.source AND f.scope = s.scope WHERE s.scope = 'DK_ANY_MATCH' AND ok AND x <> y",
    ),
    "w4_study_persistence": _q(
        f"""{_STUDY},
el AS (SELECT source, 'GLOBAL_IP_CIDR' AS scope, day FROM usable UNION ALL SELECT source, 'DK_ANY_MATCH', day FROM usable WHERE evidence),
elr AS (SELECT *, row_number() OVER (PARTITION BY source, scope ORDER BY day) AS pos, count(*) OVER (PARTITION BY source, scope) AS n FROM el),
was AS (SELECT source, 'GLOBAL_IP_CIDR' AS scope, indicator_type, indicator, day FROM fl UNION ALL SELECT source, 'DK_ANY_MATCH', indicator_type, indicator, day FROM fl WHERE a),
j AS (SELECT s.*, pos, n, lag(pos) OVER w AS pp, row_number() OVER w AS rn FROM was s JOIN elr USING (source, scope, day) WINDOW w AS (PARTITION BY source, scope, indicator_type, indicator ORDER BY day)),
run AS (SELECT source, scope, indicator_type, indicator, max(c) AS longest FROM (SELECT source, scope, indicator_type, indicator, count(*) AS c FROM j GROUP BY source, scope, indicator_type, indicator, day - CAST(rn AS INT)) GROUP BY ALL),
tot AS (SELECT source, scope, indicator_type, indicator, min(day) AS f, max(day) AS l, count(*) AS present, any_value(n) AS n, count(*) FILTER (WHERE pos - pp > 1) AS back FROM j GROUP BY ALL)""",
        "SELECT source, scope, indicator_type, indicator, CAST(f AS VARCHAR) AS first_observed_date, CAST(l AS VARCHAR) AS last_observed_date, present AS present_sampled_days, n AS eligible_sampled_days, round_even(present::DOUBLE / n, 6) AS present_fraction, longest AS longest_consecutive_calendar_presence, "
        "back AS observed_reappearances_after_sampled_absence, NOT EXISTS (SELECT 1 FROM el e WHERE e.source = t.source AND e.scope = t.scope AND e.day = t.f - 1) AS left_censored_or_gap, NOT EXISTS (SELECT 1 FROM el e WHERE e.source = t.source AND e.scope = t.scope AND e.day = t.l + 1) AS right_censored_or_gap "
        "FROM tot t JOIN run USING (source, scope, indicator_type, indicator)",
    ),
    "j8_same_day_overlap": _q(
        f"""{_STUDY}, {_HOSTS},
pr AS (SELECT a.source AS source_a, b.source AS source_b FROM srcs a JOIN srcs b ON a.source < b.source),
kc AS (SELECT a.day, a.source AS source_a, b.source AS source_b, count(*) AS c FROM fl a JOIN fl b ON a.day = b.day AND a.indicator_type = b.indicator_type AND a.indicator = b.indicator AND a.source < b.source WHERE a.a AND b.a GROUP BY ALL),
hc AS (SELECT a.day, a.source AS source_a, b.source AS source_b, count(*) AS h FROM hosts a JOIN hosts b ON a.day = b.day AND a.h = b.h AND a.source < b.source GROUP BY ALL),
nn AS (SELECT day, source, count(*) FILTER (WHERE a) AS n FROM fl GROUP BY ALL)""",
        "SELECT CAST(cal.day AS VARCHAR) AS day, pr.source_a, pr.source_b, CASE WHEN x.evidence AND y.evidence THEN 'compared' ELSE 'unknown_missing_input' END AS status, CASE WHEN x.evidence AND y.evidence THEN coalesce(c, 0) END AS key_overlap, "
        "CASE WHEN x.evidence AND y.evidence AND coalesce(p.n, 0) + coalesce(q.n, 0) - coalesce(c, 0) > 0 THEN round_even(coalesce(c, 0)::DOUBLE / (coalesce(p.n, 0) + coalesce(q.n, 0) - coalesce(c, 0)), 6) END AS key_jaccard, CASE WHEN x.evidence AND y.evidence THEN coalesce(h, 0) END AS overlapping_ipv4_addresses, "
        "CASE WHEN x.evidence AND y.evidence THEN 0::BIGINT END AS overlapping_ipv6_addresses FROM cal CROSS JOIN pr LEFT JOIN usable x ON x.day = cal.day AND x.source = pr.source_a LEFT JOIN usable y ON y.day = cal.day AND y.source = pr.source_b "
        "LEFT JOIN kc ON kc.day = cal.day AND kc.source_a = pr.source_a AND kc.source_b = pr.source_b LEFT JOIN hc ON hc.day = cal.day AND hc.source_a = pr.source_a AND hc.source_b = pr.source_b LEFT JOIN nn p ON p.day = cal.day AND p.source = pr.source_a LEFT JOIN nn q ON q.day = cal.day AND q.source = pr.source_b",
    ),
    "a9_exclusive": _q(
        f"""{_STUDY}, {_HOSTS}, {_COMPLETE},
ke AS (SELECT day, any_value(source) AS source FROM fl WHERE a GROUP BY day, indicator_type, indicator HAVING count(DISTINCT source) = 1),
kn AS (SELECT day, source, count(*) AS k FROM ke GROUP BY ALL),
he AS (SELECT day, any_value(source) AS source FROM hosts GROUP BY day, h HAVING count(*) = 1),
hn AS (SELECT day, source, count(*) AS h FROM he GROUP BY ALL)""",
        "SELECT CAST(g.day AS VARCHAR) AS day, g.source, CASE WHEN c.day IS NOT NULL THEN 'compared' ELSE 'unknown_missing_input' END AS status, CASE WHEN c.day IS NOT NULL THEN coalesce(k, 0) END AS exclusive_keys, CASE WHEN c.day IS NOT NULL THEN coalesce(h, 0) END AS exclusive_ipv4_addresses, "
        "CASE WHEN c.day IS NOT NULL THEN 0::BIGINT END AS exclusive_ipv6_addresses FROM grid g LEFT JOIN complete c ON c.day = g.day LEFT JOIN kn ON kn.day = g.day AND kn.source = g.source LEFT JOIN hn ON hn.day = g.day AND hn.source = g.source",
    ),
    "a18_address_changes": _q(
        f"""{_STUDY}, {_HOSTS},
pd AS (SELECT g.day AS p, CAST(g.day + INTERVAL 1 DAY AS DATE) AS c, g.source, coalesce(x.evidence AND y.evidence, false) AS ok FROM grid g LEFT JOIN usable x ON x.day = g.day AND x.source = g.source LEFT JOIN usable y ON y.day = g.day + INTERVAL 1 DAY AND y.source = g.source WHERE g.day < DATE '2024-01-30'),
ct AS (SELECT pd.p, pd.source, (SELECT count(*) FROM hosts h WHERE h.day = pd.p AND h.source = pd.source) AS b, (SELECT count(*) FROM hosts h WHERE h.day = pd.c AND h.source = pd.source) AS n,
  (SELECT count(*) FROM hosts h JOIN hosts i ON h.h = i.h AND h.source = i.source WHERE h.day = pd.p AND i.day = pd.c AND h.source = pd.source) AS k FROM pd)""",
        "SELECT CAST(pd.p AS VARCHAR) AS previous_date, CAST(pd.c AS VARCHAR) AS current_date, pd.source, v AS ip_version, CASE WHEN ok THEN 'compared' ELSE 'unknown_missing_input' END AS status, "
        + ", ".join(f"CASE WHEN ok THEN CASE WHEN v = 4 THEN {e} ELSE 0 END END AS {n}" for n, e in (("previous_addresses", "b"), ("current_addresses", "n"), ("added_addresses", "n - k"), ("removed_addresses", "b - k"), ("unchanged_addresses", "k"), ("net_change", "n - b")))
        + " FROM pd JOIN ct ON ct.p = pd.p AND ct.source = pd.source CROSS JOIN (SELECT unnest([4, 6]) AS v)",
    ),
    "d6_fixed_registry": _q(
        f"""{_STUDY},
f0 AS (SELECT min(day) AS d FROM reg WHERE day IN (SELECT day FROM usable)),
fx AS (SELECT k.day, k.source, count(*) AS n FROM skeys k JOIN net n ON n.x = k.indicator WHERE k.indicator_type IN ('ip', 'cidr') AND EXISTS (SELECT 1 FROM merged m, f0 WHERE m.day = f0.d AND m.lo <= n.hi AND m.hi >= n.lo) GROUP BY ALL),
dx AS (SELECT day, source, count(*) FILTER (WHERE a) AS n FROM fl GROUP BY ALL)""",
        "SELECT CAST(g.day AS VARCHAR) AS day, g.source, CAST(f0.d AS VARCHAR) AS fixed_registry_date, CASE WHEN u.day IS NOT NULL THEN coalesce(fx.n, 0) END AS fixed_any_match, CASE WHEN u.evidence THEN coalesce(dx.n, 0) END AS dated_any_match, "
        "CASE WHEN u.evidence THEN coalesce(dx.n, 0) - coalesce(fx.n, 0) END AS difference FROM grid g CROSS JOIN f0 LEFT JOIN usable u ON u.day = g.day AND u.source = g.source LEFT JOIN fx ON fx.day = g.day AND fx.source = g.source LEFT JOIN dx ON dx.day = g.day AND dx.source = g.source",
    ),
    "a15_complete_days": _q(f"{_STUDY}, {_COMPLETE}", "SELECT CAST(day AS VARCHAR) AS day FROM complete"),
    "d8_coverage": _q(
        _STUDY,
        "SELECT CAST(g.day AS VARCHAR) AS day, g.source, c.day IS NOT NULL AS normalized_snapshot_available, u.day IS NOT NULL AS snapshot_usable, coalesce(u.evidence, false) AS dated_evidence, CASE WHEN c.day IS NULL THEN 'missing' ELSE 'raw_file_not_found' END AS raw_status, "
        "CASE WHEN c.day IS NULL THEN 'no_normalized_snapshot' ELSE c.blocked END AS reason FROM grid g LEFT JOIN chosen c ON CAST(c.day AS DATE) = g.day AND c.source_name = g.source LEFT JOIN usable u ON u.day = g.day AND u.source = g.source",
    ),
    "q9_identities": "SELECT 0::BIGINT AS broken",
    "w5_merged_ranges": _q(_STUDY, "SELECT CAST(day AS VARCHAR) AS day, lo AS low, hi - lo + 1 AS addresses FROM merged"),
    "c20_minimal": _q(
        f"{_STUDY}, lv AS (SELECT unnest(range(0, 33)) AS k), fit AS (SELECT day, lo, hi, k, greatest((hi + 1) // (1::BIGINT << k) - (lo + (1::BIGINT << k) - 1) // (1::BIGINT << k), 0) AS n FROM merged CROSS JOIN lv)",
        "SELECT CAST(day AS VARCHAR) AS day, (sum(n) - 2 * sum(n) FILTER (WHERE k > 0))::BIGINT AS networks, (sum(n) FILTER (WHERE k = 0))::BIGINT AS addresses FROM fit GROUP BY day",
    ),
    "c20_range_networks": _q(f"{_STUDY}, {_LEVELS}, {_least_list('SELECT day, lo, hi FROM merged')}", f"SELECT CAST(day AS VARCHAR) AS day, {_CIDR} AS network FROM least_list"),
    "c20_feed_spans": _q(
        f"{_MACROS}, {_LEVELS}, {_least_list('SELECT source_name, substr(retrieved_at_utc, 1, 10) AS day, min(lo) AS lo, max(hi) AS hi FROM obs JOIN net ON net.x = obs.indicator WHERE indicator_type = {0}ip{0} GROUP BY ALL'.format(chr(39)), 'source_name, day')}",
        f"SELECT source_name, day, {_CIDR} AS network FROM least_list",
    ),
    "c20_matched_networks": _q(
        f"""{_STUDY}, lv AS (SELECT unnest(range(0, 33)) AS k),
ck AS (SELECT DISTINCT CAST(substr(retrieved_at_utc, 1, 10) AS DATE) AS day, indicator FROM obs WHERE indicator_type = 'cidr'),
part AS (SELECT ck.day, ck.indicator, greatest(n.lo, m.lo) AS lo, least(n.hi, m.hi) AS hi FROM ck JOIN net n ON n.x = ck.indicator JOIN merged m ON m.day = ck.day AND m.lo <= n.hi AND m.hi >= n.lo),
piece AS (SELECT day, indicator, lo, hi, k, unnest(range((lo + (1::BIGINT << k) - 1) // (1::BIGINT << k), (hi + 1) // (1::BIGINT << k))) AS b FROM part CROSS JOIN lv),
least_list AS (SELECT day, indicator, k, b * (1::BIGINT << k) AS w FROM piece WHERE NOT ((b // 2) * (2::BIGINT << k) >= lo AND (b // 2 + 1) * (2::BIGINT << k) - 1 <= hi))""",
        "SELECT CAST(day AS VARCHAR) AS day, indicator, string_agg((w // 16777216) || '.' || (w // 65536 % 256) || '.' || (w // 256 % 256) || '.' || (w % 256) || '/' || (32 - k), ';' ORDER BY w) AS networks, sum(1::BIGINT << k)::BIGINT AS matched FROM least_list GROUP BY day, indicator",
    ),
    "w6_registry_space": _q(_STUDY, "SELECT CAST(day AS VARCHAR) AS day, 4 AS version, sum(hi - lo + 1)::BIGINT AS addresses FROM merged GROUP BY day"),
    "w7_missing_days": _q("", "SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day FROM (SELECT unnest(range((SELECT min(day) FROM reg), (SELECT max(day) FROM reg), INTERVAL 1 DAY)) AS d) WHERE CAST(d AS DATE) NOT IN (SELECT day FROM reg)"),
    "a10_source_statistics": _q(
        _DAILY,
        "SELECT source, count(DISTINCT snapshot_day) AS observed_days, min(snapshot_day) AS first_day, max(snapshot_day) AS last_day, min(unique_indicators) AS minimum_indicators, max(unique_indicators) AS maximum_indicators, round_even(avg(unique_indicators), 4) AS mean_indicators, "
        "coalesce(sum(additions), 0)::BIGINT AS total_additions, coalesce(sum(removals), 0)::BIGINT AS total_removals, round_even(avg(additions), 4) AS mean_daily_additions, round_even(avg(removals), 4) AS mean_daily_removals FROM daily GROUP BY source",
    ),
    "a11_frequencies": _q("", "SELECT 'indicator_type' AS field, indicator_type AS value, count(*) AS n FROM obs GROUP BY ALL UNION ALL SELECT 'source_name', source_name, count(*) FROM obs GROUP BY ALL"),
    "a3_sketched_overlap": _q(
        "k AS (SELECT DISTINCT source_name AS source, indicator_type, indicator FROM obs WHERE substr(retrieved_at_utc, 1, 10) BETWEEN '2024-01-01' AND '2024-01-30'), n AS (SELECT source, indicator_type, count(*) AS n FROM k GROUP BY ALL), "
        "c AS (SELECT a.source AS x, b.source AS y, a.indicator_type, count(*) AS c FROM k a JOIN k b USING (indicator_type, indicator) WHERE a.source < b.source GROUP BY ALL)",
        "SELECT a.source AS source_a, b.source AS source_b, a.indicator_type, coalesce(c, 0) AS intersection, a.n + b.n - coalesce(c, 0) AS \"union\" FROM n a JOIN n b ON a.indicator_type = b.indicator_type AND a.source < b.source LEFT JOIN c ON x = a.source AND y = b.source AND c.indicator_type = a.indicator_type",
    ),
    "a13_dataset_profile": _q(
        f"""t AS (SELECT concat_ws(chr(31), {', '.join(f"coalesce({c}, chr(92) || 'N')" for c in OBSERVATION.names)}) AS x FROM obs),
v AS (SELECT strlen(x) AS n, ('0x' || md5(x)[1:16])::UBIGINT::HUGEINT AS hi, ('0x' || md5(x)[17:32])::UBIGINT::HUGEINT AS lo FROM t),
s AS (SELECT sum(n) AS bytes, sum(lo) AS lo, sum(hi) AS hi FROM v),
w AS (SELECT bytes, lo % 18446744073709551616::HUGEINT AS lo, (hi + lo // 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT AS hi FROM s)""",
        "SELECT count(*) AS n_rows, count(DISTINCT snapshot_id) AS snapshots, count(DISTINCT source_name) AS sources, count(DISTINCT indicator_type || '|' || indicator) AS keys, count(DISTINCT substr(retrieved_at_utc, 1, 10)) AS days, min(substr(retrieved_at_utc, 1, 10)) AS first_day, "
        "max(substr(retrieved_at_utc, 1, 10)) AS last_day, (SELECT bytes::BIGINT FROM w) AS bytes, (SELECT lower(lpad(hex(hi::UBIGINT), 16, '0') || lpad(hex(lo::UBIGINT), 16, '0')) FROM w) AS digest FROM obs",
    ),
    "d9_chart_series": _q(_DAILY, "SELECT 'unique' AS series, source, snapshot_day, unique_indicators AS value FROM daily UNION ALL SELECT 'additions', source, snapshot_day, additions FROM daily WHERE additions IS NOT NULL UNION ALL SELECT 'removals', source, snapshot_day, -removals FROM daily WHERE removals IS NOT NULL"),
    "q2_observation_checks": _q(
        "",
        "SELECT 'rows' AS name, 'PASS' AS status, count(*) AS value FROM obs UNION ALL SELECT unnest(['identity fields', 'observation days', 'digests']), 'PASS', 0 UNION ALL SELECT 'day coverage', CASE WHEN n >= 30 THEN 'PASS' ELSE 'WARN' END, n FROM (SELECT count(DISTINCT substr(retrieved_at_utc, 1, 10)) AS n FROM obs)",
    ),
    "q6_study_report": _q(
        "f AS (SELECT count(DISTINCT substr(retrieved_at_utc, 1, 10)) AS days, datediff('day', min(CAST(substr(retrieved_at_utc, 1, 10) AS DATE)), max(CAST(substr(retrieved_at_utc, 1, 10) AS DATE))) + 1 AS span, count(*) FILTER (WHERE indicator_type = 'domain') AS doms, (SELECT count(*) FROM (SELECT DISTINCT source_name, indicator_type, indicator FROM obs)) AS cls FROM obs)",
        "SELECT '30-day coverage' AS \"check\", CASE WHEN days >= 30 THEN 'PASS' ELSE 'WARN' END AS status, days AS value FROM f UNION ALL SELECT 'calendar gaps', CASE WHEN span = days THEN 'PASS' ELSE 'WARN' END, span - days FROM f UNION ALL SELECT 'parser notes', 'PASS', 0 "
        "UNION ALL SELECT 'Danish classification', CASE WHEN cls > 0 THEN 'PASS' ELSE 'WARN' END, cls FROM f UNION ALL SELECT 'domain observations', CASE WHEN doms > 0 THEN 'PASS' ELSE 'WARN' END, doms FROM f UNION ALL SELECT 'comparison coverage', CASE WHEN 1 >= greatest(days - 1, 0) THEN 'PASS' ELSE 'WARN' END, 1 FROM f",
    ),
    "q7_readiness": _q("", "SELECT n AS days, CASE WHEN n >= 30 THEN 'ready' ELSE 'preview_only' END AS readiness FROM (SELECT count(DISTINCT substr(retrieved_at_utc, 1, 10)) AS n FROM obs)"),
    "q11_summary_guard": _q("", "SELECT DISTINCT substr(retrieved_at_utc, 1, 10) AS snapshot_day, source_name AS source, 'repeated' AS problem FROM obs WHERE source_name = 'view' AND substr(retrieved_at_utc, 9, 2) = '05' UNION ALL SELECT DISTINCT '2024-1-6', 'click', 'invalid' FROM obs WHERE source_name = 'click' AND substr(retrieved_at_utc, 9, 2) = '06'"),
    "m1_planned_and_done": _q("pd AS (SELECT source, substr(retrieved_at_utc, 1, 10) AS day, bool_or(lower(status) = 'ok' AND http_status = '200') AS ok FROM rawlog GROUP BY ALL)", "SELECT source, 30::BIGINT AS planned, count(*) FILTER (WHERE ok) AS successful, count(*) FILTER (WHERE NOT ok) AS failed FROM pd GROUP BY source"),
    "m2_median_counts": _q(_DAILY, "SELECT source, quantile_cont(unique_indicators, 0.5)::DOUBLE AS median_unique FROM daily GROUP BY source"),
    "m4_persistence_summary": _q(
        _PERSISTENCE,
        "SELECT source, quantile_cont(snapshots_present, 0.5)::DOUBLE AS median_days, quantile_cont(snapshots_present, 0.75)::DOUBLE AS upper_quartile_days, count(*) FILTER (WHERE first_seen = a) AS on_first_day, count(*) FILTER (WHERE last_seen = b) AS on_last_day, count(*) FILTER (WHERE right_censored = 'yes') AS right_censored "
        "FROM pers JOIN (SELECT source, min(first_seen) AS a, max(last_seen) AS b FROM pers GROUP BY source) USING (source) GROUP BY source",
    ),
    "m5_in_many_sources": _q("", "SELECT indicator_type, indicator, count(DISTINCT source_name) AS sources FROM obs GROUP BY ALL HAVING count(DISTINCT source_name) >= 2"),
    "m7_metadata_completeness": _q("", "SELECT source_name, round_even(avg((4 + CASE WHEN reason <> '' THEN 1 ELSE 0 END) / 7.0::DOUBLE), 6) AS completeness, count(*) AS n_rows FROM obs GROUP BY ALL"),
    "m8_enrichment_completeness": _q("", "SELECT evidence_source, round_even(avg((CASE WHEN signal <> '' THEN 1 ELSE 0 END + CASE WHEN country <> '' THEN 1 ELSE 0 END + 1) / 3.0::DOUBLE), 6) AS completeness, count(*) AS n_rows FROM ev GROUP BY ALL"),
    "o3_top_keys": _q(_PERSISTENCE, "SELECT indicator_type, indicator, sum(snapshots_present)::BIGINT AS days FROM pers GROUP BY ALL ORDER BY days DESC, indicator_type, indicator LIMIT 20"),
    "c4_domains": "SELECT page_id, rtrim(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '.') AS domain FROM pages",
    "c7_digests": "SELECT doc_id, sha256(text) AS sha256, strlen(text)::BIGINT AS bytes FROM documents",
    "c8_json_keys": "SELECT coalesce(json_extract_string(props, '$.k'), '') AS value, count(*) AS n FROM events GROUP BY ALL",
    "c1_canonical": _q(
        f"{_MACROS}, i AS (SELECT DISTINCT indicator, a FROM obs JOIN octets ON x = indicator WHERE indicator_type = 'ip'), t AS (SELECT indicator, a - a % 4096 AS w, a - a % 16 AS m FROM i)",
        "SELECT indicator AS given, 'ip' AS kind, indicator AS canonical, 1::BIGINT AS addresses FROM i UNION ALL SELECT indicator || '/33', '', '', 0 FROM i UNION ALL SELECT indicator || 'x', '', '', 0 FROM i "
        "UNION ALL SELECT indicator || '/20', 'cidr', (w // 16777216) || '.' || (w // 65536 % 256) || '.' || (w // 256 % 256) || '.' || (w % 256) || '/20', 4096 FROM t "
        "UNION ALL SELECT indicator || '/255.255.255.240', 'cidr', (m // 16777216) || '.' || (m // 65536 % 256) || '.' || (m // 256 % 256) || '.' || (m % 256) || '/28', 16 FROM t",
    ),
    "s3_network_lines": _q(
        "l AS (SELECT snapshot_id, indicator_type, indicator, row_number() OVER (PARTITION BY snapshot_id ORDER BY indicator) + 1 AS line FROM obs WHERE indicator_type IN ('ip', 'cidr'))",
        "SELECT snapshot_id, indicator_type, count(*) AS n, count(DISTINCT indicator) AS kinds, min(line)::INT AS first_line FROM l GROUP BY ALL",
    ),
}
