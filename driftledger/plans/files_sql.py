"""DuckDB SQL of the queries over files, runs and written tables."""

from __future__ import annotations

from driftledger.plans import adapter
from driftledger.plans.oracle import _COMPLETE, _DAILY, _DAILY_STUDY, _ISSUES, _SELECT, _STUDY, EVIDENCE, _q

_FILES = adapter.ctes(raw=adapter.RAW_FILES, runs=adapter.RUNS, outs=adapter.OUTPUTS, feed=adapter.FEED_LINES)
_AT = "substr(stamp, 1, 4) || '-' || substr(stamp, 5, 2) || '-' || substr(stamp, 7, 5) || ':' || substr(stamp, 12, 2) || ':' || substr(stamp, 14)"


def _check(name: str, column: str, rows: str, bad: str = "FAIL") -> str:
    """A check as a row: the faulty rows' number and the four first of their values."""
    return f"SELECT '{name}' AS name, CASE WHEN (SELECT count(*) {rows}) = 0 THEN 'PASS' ELSE '{bad}' END AS status, (SELECT count(*) {rows}) AS value, coalesce((SELECT string_agg(x, ', ' ORDER BY x) FROM (SELECT DISTINCT {column} AS x {rows} ORDER BY x LIMIT 4)), '') AS message"


_OK = "FROM rawlog l {0} JOIN raw f ON f.path = l.path WHERE lower(l.status) = 'ok'"
_LOGGED = " UNION ALL ".join(
    (
        _check("log states", "status", "FROM rawlog WHERE lower(status) NOT IN ('ok', 'failed', 'skipped')"),
        _check("logged files exist", "l.path", _OK.format("LEFT") + " AND f.path IS NULL"),
        _check("logged sizes", "l.path", _OK.format("") + " AND CAST(l.bytes AS INT) <> f.bytes"),
        _check("logged digests", "l.path", _OK.format("") + " AND l.sha256 <> f.sha256"),
    )
)
_OUTPUTS = " UNION ALL ".join((_check("outputs exist", "o.path", "FROM outs o WHERE o.path NOT IN (SELECT path FROM raw)"), _check("output digests", "o.path", "FROM outs o JOIN raw f ON f.path = o.path WHERE f.sha256 <> o.sha256")))
_RUNS = " UNION ALL ".join((_check("run states", "run_id", "FROM runs WHERE status = 'broken'"), _check("run folders", "run_id", "FROM runs WHERE folder <> run_id", "WARN")))
_ALL_ISSUES = "SELECT * FROM issues UNION ALL SELECT 'WARN', 'invalid_evidence_cache', d, '' FROM told WHERE problem <> ''"


def _files(parts: str, select: str) -> str:
    return _q(f"{_FILES}{', ' + parts if parts else ''}", select)


#: Events of JSON files without a broken line, and those files that have one.
SOUND = "(SELECT * FROM feed WHERE (s, stamp, part) NOT IN (SELECT (s, stamp, part) FROM feed WHERE n % 9 = 4 AND k % 7 = 0))"


def _feed(name: str, kind: str, indicator: str, reason: str, rows: str = "feed") -> str:
    return f"SELECT '{name}' AS source_name, '{kind}' AS indicator_type, {_AT} AS retrieved_at_utc, count(*) AS n, count(DISTINCT {indicator}) AS indicators, count(DISTINCT s || '_' || part) AS snapshots, min({indicator}) AS least, max({reason}) AS reason, 64 AS digest_length FROM {rows} GROUP BY stamp"


SQL: dict[str, str] = {
    "s4_feed_formats": _files("", " UNION ALL ".join((_feed("FireHOL", "ip", "ip", "''"), _feed("blocklist.de", "ip", "ip", "''"), _feed("Spamhaus DROP", "cidr", "cidr", "'S' || u", SOUND), _feed("URLhaus", "url", "'http://H' || u || '.Example.org/a,b'", "'say \"x\"'")))),
    "s7_parse_notes": _files("", "SELECT DISTINCT '/lake/data/raw/' || s || '/unrouted_' || s || '_' || part || '_' || stamp || '.txt' AS path, 'no parser for this file name' AS error FROM feed UNION ALL SELECT DISTINCT '/lake/data/raw/' || s || '/spamhaus_' || s || '_' || part || '_' || stamp || '.json', 'a line is not JSON' FROM feed WHERE n % 9 = 4 AND k % 7 = 0"),
    "j11_raw_files": _files(
        f"""{_SELECT},
lost AS (SELECT 'exact' AS log_match, source, day, max(seen) AS seen FROM unseen GROUP BY ALL UNION ALL SELECT 'digest', source, day, max(seen) FROM good_log g WHERE NOT EXISTS (SELECT 1 FROM snap s WHERE s.source_name = g.source AND s.sha = g.sha256) GROUP BY ALL),
st AS (SELECT m AS log_match, t.*, CASE WHEN f.path IS NULL THEN 'raw_file_not_found' WHEN f.sha256 = t.sha THEN 'hash_verified' ELSE 'hash_mismatch' END AS raw_status FROM top t LEFT JOIN raw f ON f.path = t.path CROSS JOIN (SELECT unnest(['exact', 'digest']) AS m))""",
        "SELECT log_match, source_name, st.day, snapshot_id, raw_status, CASE WHEN lost.seen >= st.seen THEN 'newer_download_not_normalized' WHEN raw_status = 'hash_mismatch' THEN 'raw_hash_mismatch' ELSE '' END AS blocked FROM st LEFT JOIN lost USING (log_match) WHERE (lost.source = source_name AND lost.day = st.day) "
        "UNION ALL SELECT log_match, source_name, day, snapshot_id, raw_status, CASE WHEN raw_status = 'hash_mismatch' THEN 'raw_hash_mismatch' ELSE '' END FROM st WHERE NOT EXISTS (SELECT 1 FROM lost l WHERE l.log_match = st.log_match AND l.source = source_name AND l.day = st.day)",
    ),
    "j12_logged_files": _files("", _LOGGED),
    "q3_outputs": _files("", _OUTPUTS),
    "q4_runs": _files("", _RUNS),
    "q5_overall": _files("", f"SELECT CASE WHEN count(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'failed' WHEN count(*) FILTER (WHERE status = 'WARN') > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS status, count(*) AS checks FROM ({_LOGGED} UNION ALL {_OUTPUTS} UNION ALL {_RUNS})"),
    "q8_issues": _q(f"{_STUDY},{_ISSUES},{EVIDENCE}", f"SELECT severity, code, date, source, count(*) AS n FROM ({_ALL_ISSUES}) GROUP BY ALL"),
    "a16_study_status": _q(
        f"{_STUDY},{_ISSUES},{EVIDENCE}, {_COMPLETE}",
        f"SELECT e AS errors, w AS warnings, d AS complete_days, CASE WHEN e > 0 THEN 'blocked' WHEN d < 30 THEN 'interim' ELSE 'month_scale' END AS readiness FROM (SELECT count(*) FILTER (WHERE severity = 'ERROR') AS e, count(*) FILTER (WHERE severity = 'WARN') AS w FROM ({_ALL_ISSUES})), (SELECT count(*) AS d FROM complete)",
    ),
    "q10_changed_inputs": _files("", "SELECT coalesce(o.path, f.path) AS path FROM (SELECT path, sha256 FROM outs) o FULL JOIN raw f ON f.path = o.path WHERE o.sha256 IS DISTINCT FROM f.sha256"),
    "a17_comparison_coverage": _files("", "SELECT previous_day, current_day, generated_at_utc, run_id, status, missing AS missing_sources, versions FROM (SELECT *, count(*) OVER (PARTITION BY current_day) AS versions FROM runs WHERE previous_day <> '') QUALIFY row_number() OVER (PARTITION BY current_day ORDER BY generated_at_utc DESC) = 1"),
    "a19_status_counts": _files("", "SELECT (SELECT count(*) FROM obs) AS observation_rows, (SELECT count(DISTINCT substr(retrieved_at_utc, 1, 10)) FROM obs) AS days, count(*) AS runs, count(DISTINCT current_day) FILTER (WHERE previous_day <> '') AS comparisons FROM runs"),
    "c21_run_kinds": _files("", "SELECT run_id, CASE collection_status WHEN 'succeeded' THEN 'daily collection' WHEN 'skipped' THEN 'replay' WHEN 'failed' THEN 'collection failed' ELSE 'pipeline run' END AS kind, current_day AS run_day, CASE WHEN run_id LIKE '%am' THEN '06:00:00' ELSE '18:00:00' END AS run_time, status FROM runs"),
    "w10_newest_runs": _files("", "SELECT row_number() OVER (ORDER BY generated_at_utc DESC) AS place, run_id, generated_at_utc FROM runs"),
    "f10_runs_of_day": _files("", "SELECT run_id, status, n_rows FROM runs WHERE current_day = '2024-01-14'"),
    "s12_registry_checks": _q(EVIDENCE, "SELECT d AS requested_date, meta AS metadata_path, problem FROM told"),
    "s11_registry_networks": _q(EVIDENCE, "SELECT d AS day, 4 AS version, c AS networks FROM told WHERE problem = '' UNION ALL SELECT d, 6, 1 FROM told WHERE problem = ''"),
    "d10_evidence_index": _q(EVIDENCE, "SELECT 'DK' AS country, d AS requested_date, d || '.json' AS response_file, meta AS metadata_path, '/lake/registry/' || d || '.json' AS response_path FROM told WHERE problem = ''"),
    "x6_expected_sources": _q(f"{_STUDY},{_DAILY_STUDY}", "SELECT source, count(*) AS days, count(*) FILTER (WHERE status = 'usable') AS usable_days, sum(global_ip_cidr)::BIGINT AS keys, 0::BIGINT AS complete_days FROM sdaily GROUP BY source UNION ALL SELECT 'expected_feed', 30, 0, NULL, 0"),
    "f11_study_window": _q(
        "e AS (SELECT min(CAST(substr(retrieved_at_utc, 1, 10) AS DATE)) AS a, max(CAST(substr(retrieved_at_utc, 1, 10) AS DATE)) AS b FROM obs), w AS (SELECT 'default' AS window, a, b FROM e UNION ALL SELECT 'from a day', DATE '2024-01-14', b FROM e)",
        'SELECT w.window AS "window", CAST(CAST(unnest(range(a, b + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS day FROM w',
    ),
    "c19_portable_paths": _q(
        "p AS (SELECT DISTINCT source_path AS x FROM obs)",
        "SELECT x AS given, x AS portable FROM p UNION ALL SELECT 'C:\\work\\' || replace(x, '/', '\\'), x FROM p UNION ALL SELECT '/lake/' || x, x FROM p UNION ALL SELECT 'my' || x, '' FROM p UNION ALL SELECT replace(x, 'data/raw/', 'data/raw/../'), '' FROM p",
    ),
    "c5_snapshot_ids": _q(
        "",
        "SELECT DISTINCT substr(source_path, length(source_path) - 16) AS name, source_name, retrieved_at_utc AS at, substr(source_path, length(source_path) - 16, 13) || '_' || replace(replace(retrieved_at_utc, ':', ''), '-', '') AS snapshot_id, 'feed_' || source_name AS slug FROM obs "
        "UNION SELECT source_name || '_20240229T010203Z.csv', source_name, '2024-02-29T01:02:03Z', source_name || '_20240229T010203Z', 'feed_' || source_name FROM obs",
    ),
    "k1_written_table": _q("", "SELECT source_name, count(*) AS n, count(DISTINCT snapshot_id) AS snapshots, count(DISTINCT indicator_type || '|' || indicator) AS indicators FROM obs GROUP BY ALL"),
    "k2_split_tables": _q(_STUDY, "SELECT source, 'all' AS \"table\", count(*) AS n, sum(matched)::BIGINT AS addresses FROM members GROUP BY source UNION ALL SELECT source, 'matched', count(*), sum(matched)::BIGINT FROM members WHERE matched > 0 GROUP BY source"),
    "k3_sources_apart": _q(_DAILY, "SELECT source AS source_slug, count(*) AS n, sum(unique_indicators)::BIGINT AS unique_indicators FROM daily GROUP BY source"),
    "k4_exported_summary": _q(
        _DAILY,
        "SELECT source, snapshot_day, CAST(unique_indicators AS VARCHAR) AS unique_indicators, CAST(unique_ips_cidrs AS VARCHAR) AS unique_ips_cidrs, CAST(unique_domains_urls AS VARCHAR) AS unique_domains_urls, coalesce(CAST(additions AS VARCHAR), 'NA') AS additions, coalesce(CAST(removals AS VARCHAR), 'NA') AS removals, CAST(raw_rows AS VARCHAR) AS raw_rows FROM daily",
    ),
    "k4_empty_table": _q(_DAILY, "SELECT 'source,snapshot_day,unique_indicators,unique_ips_cidrs,unique_domains_urls,additions,removals,raw_rows' AS header, count(*) AS n FROM daily WHERE raw_rows < 0"),
    "k6_run_index": _q(_DAILY, "SELECT 'observations' AS \"table\", (SELECT count(*) FROM obs) AS n, 0 AS bad_entries, 0 AS changed_files, 'refused' AS second_run UNION ALL SELECT 'daily_summary', (SELECT count(*) FROM daily), 0, 0, 'refused'"),
    "o1_ordered_files": _q("", "SELECT 0 AS overlapping, count(*) AS n FROM (SELECT DISTINCT source_name, indicator_type, indicator FROM obs)"),
    "o2_numbered_keys": _q("", "SELECT source, indicator_type, indicator, row_number() OVER (ORDER BY source, indicator_type, indicator) AS place FROM (SELECT DISTINCT source_name AS source, indicator_type, indicator FROM obs)"),
    "s13_manifest_files": _files(
        "m AS (SELECT r.*, CAST(substr(current_day, 9, 2) AS INT) AS n, (SELECT count(DISTINCT path) FROM outs o WHERE o.run_id = r.run_id) AS files FROM runs r), e AS (SELECT *, CASE WHEN n % 5 = 2 THEN 'not JSON' WHEN n % 5 = 3 THEN 'not an object' WHEN n % 5 <> 1 AND n % 7 = 4 THEN 'no run_id' ELSE '' END AS error FROM m)",
        "SELECT run_id AS folder, error, CASE WHEN error = '' THEN run_id ELSE '' END AS run_id, CASE WHEN error IN ('', 'no run_id') THEN status ELSE '' END AS status, CASE WHEN error = '' THEN n_rows END AS n_rows, CASE WHEN error = '' THEN current_day ELSE '' END AS days, CASE WHEN error = '' THEN files END AS outputs FROM e",
    ),
    "k7_one_day": _q(_DAILY, "SELECT source, snapshot_day, CAST(unique_indicators AS VARCHAR) AS unique_indicators, CAST(raw_rows AS VARCHAR) AS raw_rows FROM daily WHERE snapshot_day = '2024-01-14'"),
}
