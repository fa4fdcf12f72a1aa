"""The derived change log as SQL, for the oracle strings."""

LOG = """
b AS (SELECT event_id % 4 + 1 AS origin, epoch_us(ts) // 1000 AS wall, user_id AS pk, event_type AS et, value, event_id, cast(round(value) AS BIGINT) AS delta FROM events),
st AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY wall, event_id) AS seq,
       max(CASE WHEN et IN ('signup', 'error') THEN event_id * 2 + CASE WHEN et = 'signup' THEN 1 ELSE 0 END END)
         OVER (PARTITION BY pk ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM b),
lv AS (SELECT *, coalesce(k % 2, 0) AS live FROM st),
fl AS (SELECT *, coalesce(lag(live) OVER (PARTITION BY pk ORDER BY event_id), 0) AS prev FROM lv),
cl AS (SELECT *, sum(abs(live - prev)) OVER (PARTITION BY pk ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cl FROM fl),
log AS (SELECT origin, seq, (wall + CASE origin WHEN 3 THEN 864000000 WHEN 4 THEN -7200000 ELSE 0 END) * 65536 AS hlc, pk, cast(cl AS BIGINT) AS cl,
        CASE WHEN et = 'signup' THEN CASE WHEN prev = 0 THEN 'I' ELSE 'U' END WHEN et = 'error' THEN 'D' ELSE 'U' END AS op,
        CASE WHEN et IN ('signup', 'click') THEN value END AS a, CASE WHEN et IN ('signup', 'view') THEN et END AS b,
        CASE WHEN et = 'purchase' THEN delta WHEN et = 'signup' AND prev = 0 THEN delta END AS n, event_id
        FROM cl WHERE et = 'signup' OR prev = 1),
rowlog AS (SELECT * REPLACE (last_value(a IGNORE NULLS) OVER w AS a, last_value(b IGNORE NULLS) OVER w AS b) FROM log
           WINDOW w AS (PARTITION BY pk, cl ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
newest AS (SELECT * FROM (SELECT *, max(cl) OVER (PARTITION BY pk) AS top FROM log) WHERE cl = top)
"""


def over_log(query: str, more: str = "") -> str:
    """``query`` with the log's tables before it."""
    return f"WITH {LOG}{', ' + more if more else ''} {query}"
