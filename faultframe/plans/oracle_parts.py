"""Shared pieces of the oracle SQL: the views of sources/views.py written independently for DuckDB."""

import re

# 1 s windows, 0.5 s steps, 100 Hz: 100 and 50 points.
CTES = {
    "raw": """
        SELECT event_type || '_' || CAST(user_id % 4 AS VARCHAR) AS flight_id, event_id,
               (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / CAST(1000000 AS DOUBLE) / CAST(90000 AS DOUBLE) AS t,
               value AS q_1, CAST(json_extract(props, '$.k') AS DOUBLE) AS q_2, CAST(user_id AS DOUBLE) AS q_3
        FROM events""",
    "flights": """
        SELECT DISTINCT event_type || '_' || CAST(user_id % 4 AS VARCHAR) AS flight_id, CAST(user_id % 4 AS INTEGER) AS sv,
               CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
                               WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS code
        FROM events""",
    "files": """
        SELECT flight_id, code, sv, 'D' || (1 + code % 3) || '_F' || code || '_SV' || sv || '_SP' || (1 + sv % 2)
               || '_t' || (1 + code) || '.mat' AS file_name
        FROM flights""",
    "flight_labels": """
        SELECT flight_id, file_name, CAST(code = 0 AS INTEGER) AS healthy,
               CASE code WHEN 0 THEN 'none' WHEN 1 THEN 'crack' WHEN 2 THEN 'edge_cut' WHEN 3 THEN 'surface_cut'
                         ELSE 'other' END AS fault_type,
               CASE WHEN code = 0 THEN 0 ELSE sv END AS severity, 1 + code AS trajectory,
               'D' || (1 + code % 3) AS drone_id, 1 + sv % 2 AS speed_case
        FROM files""",
    "spans": """
        SELECT flight_id, min(t) AS t0, max(t) AS t1, CAST(floor((max(t) - min(t)) * 100) AS BIGINT) + 1 AS n
        FROM raw GROUP BY flight_id""",
    "window_list": """
        SELECT flight_id, t0, t1, n,
               unnest(range(CASE WHEN n > 100 THEN CAST(ceil((n - 100) / 50) AS BIGINT) ELSE 0 END)) AS w
        FROM spans""",
    "centres": """
        SELECT flight_id, w, (w * 50 + 50) * ((t1 - t0) / (n - 1)) + t0 AS t FROM window_list""",
    "points": """
        SELECT flight_id, k, n, CASE WHEN n = 1 THEN t0 WHEN k = n - 1 THEN t1 ELSE k * ((t1 - t0) / (n - 1)) + t0 END AS t
        FROM (SELECT flight_id, t0, t1, n, unnest(range(n)) AS k FROM spans)""",
    "segments": """
        SELECT flight_id, t, q_1, q_2, q_3, lead(t) OVER o AS nt, lead(q_1) OVER o AS n1, lead(q_2) OVER o AS n2,
               lead(q_3) OVER o AS n3
        FROM raw WINDOW o AS (PARTITION BY flight_id ORDER BY t, event_id)""",
    "grid": """
        SELECT p.flight_id, p.k, p.n, p.t,
               CASE WHEN s.nt IS NULL OR p.t = s.t THEN q_1 ELSE (n1 - q_1) * ((p.t - s.t) / (nt - s.t)) + q_1 END AS q_1,
               CASE WHEN s.nt IS NULL OR p.t = s.t THEN q_2 ELSE (n2 - q_2) * ((p.t - s.t) / (nt - s.t)) + q_2 END AS q_2,
               CASE WHEN s.nt IS NULL OR p.t = s.t THEN q_3 ELSE (n3 - q_3) * ((p.t - s.t) / (nt - s.t)) + q_3 END AS q_3
        FROM points p ASOF JOIN segments s ON p.flight_id = s.flight_id AND p.t >= s.t""",
    "grid_long": """
        SELECT flight_id, k, n, t, 'q_1' AS channel, q_1 AS value FROM grid UNION ALL
        SELECT flight_id, k, n, t, 'q_2', q_2 FROM grid UNION ALL SELECT flight_id, k, n, t, 'q_3', q_3 FROM grid""",
    "stats": """
        SELECT channel, avg(value) AS mean, stddev_samp(value) AS std FROM grid_long GROUP BY channel""",
    "norm": """
        SELECT g.flight_id, g.k, g.n, g.t, channel,
               (value - mean) / CASE WHEN std = 0 THEN 1 ELSE std END AS value
        FROM grid_long g JOIN stats USING (channel)""",
    "win": """
        SELECT l.flight_id, l.w, CAST(g.k - l.w * 50 AS INTEGER) AS i, g.channel, g.value, g.t
        FROM norm g JOIN window_list l ON l.flight_id = g.flight_id AND g.k >= l.w * 50 AND g.k < l.w * 50 + 100""",
    "time_feats": """
        SELECT flight_id, w, channel, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max,
               max(value) - min(value) AS ptp, sqrt(avg(value * value)) AS rms,
               CASE WHEN max(value) > min(value) THEN avg(d * d * d) / power(avg(d * d), 1.5) END AS skew,
               CASE WHEN max(value) > min(value) THEN avg(d * d * d * d) / power(avg(d * d), 2) - 3 END AS kurt
        FROM (SELECT *, value - avg(value) OVER (PARTITION BY flight_id, w, channel) AS d FROM win)
        GROUP BY flight_id, w, channel""",
    "spectrum": """
        SELECT flight_id, w, channel, CAST(b AS INTEGER) AS bin, b * CAST(100 AS DOUBLE) / 100 AS freq,
               (power(sum(value * cos(2 * pi() * b * i / 100)), 2) + power(sum(value * sin(2 * pi() * b * i / 100)), 2)) / 100 AS psd
        FROM win CROSS JOIN (SELECT unnest(range(51)) AS b)
        GROUP BY flight_id, w, channel, b""",
    "trapezes": """
        SELECT flight_id, w, channel, freq AS f0, lead(freq) OVER o AS f1,
               (psd + lead(psd) OVER o) / 2 * (lead(freq) OVER o - freq) AS area
        FROM spectrum WINDOW o AS (PARTITION BY flight_id, w, channel ORDER BY bin)""",
    "powers": """
        SELECT flight_id, w, channel, sum(area) AS power_total, sum(area) FILTER (f1 <= 5) AS power_low,
               sum(area) FILTER (f0 >= 5 AND f1 <= 20) AS power_mid, sum(area) FILTER (f0 >= 20) AS power_high
        FROM trapezes GROUP BY flight_id, w, channel""",
    "peaks": """
        SELECT flight_id, w, channel, freq AS f_peak, psd AS psd_peak
        FROM (SELECT *, row_number() OVER (PARTITION BY flight_id, w, channel ORDER BY psd DESC, bin) AS r FROM spectrum)
        WHERE r = 1""",
    "truth": """
        SELECT flight_id, CASE WHEN code = 0 THEN 0 ELSE 1 END AS y_fault, code AS y_type,
               CASE WHEN code = 0 THEN 0 ELSE sv END AS y_sev FROM flights""",
    "hashed": """
        SELECT model, cut, flight_id, w, t, y_fault, y_type, y_sev,
               md5(model || '|' || flight_id || '|' || CAST(w AS VARCHAR)) AS h
        FROM centres JOIN truth USING (flight_id)
        CROSS JOIN (VALUES ('boost', 1), ('forest', 2), ('neighbours', 4)) AS m(model, cut)""",
    "drawn": """
        SELECT *, instr('0123456789abcdef', substr(h, 1, 1)) - 1 < cut AS wrong,
               instr('0123456789abcdef', substr(h, 2, 1)) - 1 AS d2,
               (instr('0123456789abcdef', substr(h, 3, 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, 4, 1)) - 1 AS d34
        FROM hashed""",
    "pred": """
        SELECT *, CAST(fault_prob >= 0.5 AS INTEGER) AS fault_label,
               CAST(greatest(0, least(3, CAST(round_even(severity_continuous, 0) AS INTEGER))) AS INTEGER) AS severity_level,
               CASE fault_type WHEN 0 THEN 'none' WHEN 1 THEN 'crack' WHEN 2 THEN 'edge_cut' WHEN 3 THEN 'surface_cut'
                               ELSE 'Unknown (' || CAST(fault_type AS VARCHAR) || ')' END AS fault_type_name
        FROM (SELECT model, flight_id, w, t, y_fault, y_type, y_sev,
                     d34 / CAST(512 AS DOUBLE) + CASE WHEN (y_fault = 1) <> wrong THEN 0.5 ELSE 0 END AS fault_prob,
                     y_sev + (d2 - 8) / CAST(8 AS DOUBLE) + CASE WHEN wrong THEN 1 ELSE 0 END AS severity_continuous,
                     CASE WHEN wrong THEN (y_type + 1) % 5 ELSE y_type END AS fault_type
              FROM drawn)""",
    "window_split": """
        SELECT flight_id, w, y_fault, y_type, y_sev,
               row_number() OVER (PARTITION BY y_fault ORDER BY md5('42|' || flight_id || '|' || CAST(w AS VARCHAR)), flight_id, w) - 1
                 < round(count(*) OVER (PARTITION BY y_fault) * 0.2) AS is_test
        FROM centres JOIN truth USING (flight_id)""",
    "vectors": """
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings""",
    "cells": """
        SELECT vec_id, label, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM vectors""",
    "vector_split": """
        SELECT vec_id, vec, label,
               CAST(CASE WHEN label > 0 THEN 100 ELSE 0 END + (label % 4) * 10 + label // 4 AS INTEGER) AS code,
               row_number() OVER (PARTITION BY label ORDER BY md5('42|' || CAST(vec_id AS VARCHAR)), vec_id) - 1
                 < round(count(*) OVER (PARTITION BY label) * 0.2) AS is_test
        FROM vectors""",
    "train_cells": """
        SELECT vec_id, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM vector_split WHERE NOT is_test""",
    "train_stats": """
        SELECT pos, avg(x) AS mean, stddev_pop(x) AS std FROM train_cells GROUP BY pos""",
    "scaled": """
        SELECT vec_id, code, is_test, list(z ORDER BY pos) AS vec
        FROM (SELECT vec_id, code, is_test, c.pos, (x - mean) / CASE WHEN std = 0 THEN 1 ELSE std END AS z
              FROM (SELECT vec_id, code, is_test, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM vector_split) c
              JOIN train_stats USING (pos))
        GROUP BY vec_id, code, is_test""",
    "near": """
        SELECT qid, rank, id, code, distance
        FROM (SELECT q.vec_id AS qid, t.vec_id AS id, t.code, list_distance(q.vec, t.vec) AS distance,
                     row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.vec, t.vec), 9), t.vec_id) AS rank
              FROM scaled q JOIN scaled t ON q.is_test AND NOT t.is_test)
        WHERE rank <= 5""",
    "voted": """
        SELECT qid, code, votes
        FROM (SELECT qid, code, count(*) AS votes,
                     row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, code) AS r
              FROM near GROUP BY qid, code)
        WHERE r = 1""",
    "items": """
        SELECT l_returnflag AS class, 'l_quantity' AS channel, l_quantity AS value FROM lineitem UNION ALL
        SELECT l_returnflag, 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL
        SELECT l_returnflag, 'l_discount', l_discount FROM lineitem UNION ALL
        SELECT l_returnflag, 'l_tax', l_tax FROM lineitem""",
    "profile": """
        SELECT channel, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max,
               avg(CASE WHEN value = 0 THEN 1 ELSE 0 END) * 100 AS zeros_pct, quantile_cont(value, 0.25) AS q25,
               quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75, max(value) - min(value) AS range
        FROM items GROUP BY channel""",
    "joined_labels": """
        SELECT doc_id, quality, toxic, lang, source FROM labels JOIN documents USING (doc_id)""",
    "label_sets": """
        SELECT 'y_fault' AS label_set, y_fault AS label FROM truth JOIN centres USING (flight_id) UNION ALL
        SELECT 'y_type', y_type FROM truth JOIN centres USING (flight_id) UNION ALL
        SELECT 'y_sev', y_sev FROM truth JOIN centres USING (flight_id)""",
    "runs": """
        SELECT o_orderpriority AS run, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS epoch,
               avg(o_totalprice) / 1000 AS val_loss
        FROM orders GROUP BY ALL""",
    "run_log": """
        SELECT run, epoch, train_loss, val_loss
        FROM runs JOIN (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS epoch,
                               avg(o_totalprice) / 1000 AS train_loss FROM orders GROUP BY ALL) USING (epoch)""",
}


def sql(body: str) -> str:
    """The statement with the shared pieces it uses, in order of dependency."""
    needed, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(CTES[name])
    used = ",\n".join(f"{name} AS ({text})" for name, text in CTES.items() if name in needed)
    body = body.strip()
    if not used:
        return body
    return f"WITH {used}, {body[5:]}" if body.startswith("WITH ") else f"WITH {used}\n{body}"
