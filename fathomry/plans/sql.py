"""SQL fragments that several queries' comparisons share."""

#: One spelling of an address, for SQL: IPv6 groups are written out, freed of leading zeros and compressed.
ADDRESSES = r"""
ipt AS (SELECT DISTINCT ip AS raw, lower(trim(ip)) AS s FROM checkin_events WHERE ip IS NOT NULL),
ipm AS (SELECT raw, CASE WHEN regexp_matches(s, '^::ffff:[0-9.]+$') THEN s[8:] ELSE s END AS s FROM ipt),
ipg AS (
  SELECT raw, s, string_split(s, '::') AS h,
    list_filter(string_split(string_split(s, '::')[1], ':'), lambda x: x <> '') AS l,
    list_filter(string_split(coalesce(string_split(s, '::')[2], ''), ':'), lambda x: x <> '') AS r
  FROM ipm WHERE regexp_matches(s, '^[0-9a-f:]+$') AND contains(s, ':')
),
ipf AS (SELECT raw, list_transform(CASE WHEN len(h) = 2 THEN l || list_resize([]::VARCHAR[], 8 - len(l) - len(r), '0') || r ELSE l END,
          lambda x: CASE WHEN regexp_matches(x, '^0+$') THEN '0' ELSE ltrim(x, '0') END) AS g FROM ipg),
ipz AS (SELECT raw, ':' || list_aggregate(g, 'string_agg', ':') || ':' AS t FROM ipf WHERE len(g) = 8),
ipk AS (SELECT raw, t, (SELECT max(k) FROM range(2, 9) q(k) WHERE contains(t, repeat(':0', k::INT) || ':')) AS k FROM ipz),
ipc AS (
  SELECT raw, s AS canon FROM ipm WHERE regexp_matches(s, '^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.|$)){4}$')
    AND NOT s LIKE '%.'
  UNION ALL
  SELECT raw, CASE WHEN k IS NULL THEN t[2:-2] ELSE
    regexp_replace(regexp_replace(t[1:instr(t, repeat(':0', k::INT) || ':') - 1] || '::' || t[instr(t, repeat(':0', k::INT) || ':') + 2 * k::INT + 1:],
      '^:([^:])', '\1'), '([^:]):$', '\1') END AS canon FROM ipk
)"""
