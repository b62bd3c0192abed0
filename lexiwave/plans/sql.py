"""DuckDB SQL of the language-model queries, put together from common table expressions."""

from __future__ import annotations

import math

TOKENS = r"list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}<>/.]+'), lambda x: lower(x)), lambda x: x NOT IN ('<s>', '</s>'))"


def seqs(name: str = "seq", table: str = "documents", model: str = "coalesce(lang, 'und')") -> str:
    return f"{name} AS (SELECT {model} AS model, {TOKENS} AS toks FROM {table})"


def pads(n: int, name: str = "pad", source: str = "seq", ended: bool = True) -> str:
    if n == 1:
        body = "toks" if ended else "list_concat(toks, ['</s>'])"
    else:
        start = ", ".join(["'<s>'"] * (n - 1))
        body = f"list_concat(list_concat([{start}], toks), ['</s>'])"
    return f"{name} AS (SELECT model, {body} AS p FROM {source})"


def grams(m: int, source: str = "pad") -> str:
    return f"SELECT model, {m} AS ord, unnest(list_transform(range(1, greatest(len(p) - {m} + 2, 1)), lambda i: p[i:i + {m} - 1])) AS gram FROM {source}"


def counts(n: int, name: str = "cnts", source: str = "pad") -> str:
    union = " UNION ALL ".join(grams(m, source) for m in range(1, n + 1))
    return f"{name} AS MATERIALIZED (SELECT model, ord, gram, count(*) AS cnt FROM ({union}) GROUP BY ALL)"


def counts_of(n: int) -> str:
    """Counts of order n alone."""
    return f"cnts AS MATERIALIZED (SELECT model, ord, gram, count(*) AS cnt FROM ({grams(n)}) GROUP BY ALL)"


def vocab(n: int) -> str:
    marks = "['<unk>']" if n == 1 else "['<s>', '</s>', '<unk>']"
    return (
        f"voc AS (SELECT DISTINCT model, unnest(toks) AS token FROM seq UNION SELECT DISTINCT model, unnest({marks}) AS token FROM seq), "
        "vsize AS (SELECT model, count(*) AS v FROM voc GROUP BY model)"
    )


def contexts(n: int, name: str = "ctxs") -> str:
    return f"{name} AS MATERIALIZED (SELECT model, gram[1:{n - 1}] AS ctx, sum(cnt) AS ctx_cnt FROM cnts WHERE ord = {n} GROUP BY ALL)"


def neglog(p: str) -> str:
    return f"(CASE WHEN {p} IS NULL OR {p} < 1e-15 THEN 'inf'::DOUBLE ELSE -ln({p}) END)"


def r6(x: str) -> str:
    return f"(CASE WHEN isinf({x}) THEN {x} ELSE round({x}, 6) + 0.0 END)"


def model_base(n: int) -> str:
    return ", ".join([seqs(), pads(n), counts(n), vocab(n), contexts(n)])


def additive_probs(n: int, a: float) -> str:
    p = f"((cnt + {a}) / nullif(ctx_cnt + {a} * v, 0)::DOUBLE)"
    return (
        f"WITH {model_base(n)} SELECT c.model, array_to_string(c.gram, ' ') AS gram, c.cnt, {r6(neglog(p))} AS nlp FROM cnts c "
        f"JOIN ctxs x ON c.model = x.model AND c.gram[1:{n - 1}] = x.ctx JOIN vsize s ON c.model = s.model WHERE c.ord = {n}"
    )


def test_windows(n: int) -> str:
    """``test``: (model, gram, times) of the benchmark's windows for every model."""
    tests = f"tseq AS (SELECT m.model, {TOKENS} AS toks FROM benchmark CROSS JOIN (SELECT DISTINCT model FROM seq) m)"
    raw = f"raw AS (SELECT model, gram, count(*) AS times FROM ({grams(n, 'tpad')}) GROUP BY model, gram)"
    words = ", ".join(f"CASE WHEN v{i}.token IS NULL THEN '<unk>' ELSE raw.gram[{i + 1}] END" for i in range(n))
    joins = " ".join(f"LEFT JOIN voc v{i} ON v{i}.model = raw.model AND v{i}.token = raw.gram[{i + 1}]" for i in range(n))
    return f"{tests}, {pads(n, 'tpad', 'tseq', False)}, {raw}, test AS (SELECT raw.model, [{words}] AS gram, sum(times) AS times FROM raw {joins} GROUP BY ALL)"


def _perplexity(ctes: str, scored: str) -> str:
    total = "exp(sum(times * nlp) / sum(times))"
    return f"WITH {ctes}, scored AS ({scored}) SELECT model, CAST(sum(times) AS BIGINT) AS windows, {r6(total)} AS perplexity FROM scored GROUP BY model"


def perplexity_additive(n: int, a: float) -> str:
    p = f"((coalesce(cnt, 0) + {a}) / nullif(coalesce(ctx_cnt, 0) + {a} * v, 0)::DOUBLE)"
    scored = (
        f"SELECT t.model, times, {neglog(p)} AS nlp FROM test t LEFT JOIN (SELECT * FROM cnts WHERE ord = {n}) c ON c.model = t.model AND c.gram = t.gram "
        f"LEFT JOIN ctxs x ON x.model = t.model AND x.ctx = t.gram[1:{n - 1}] JOIN vsize s ON s.model = t.model"
    )
    return _perplexity(f"{model_base(n)}, {test_windows(n)}", scored)


def good_turing(n: int) -> str:
    return f"""nr AS (SELECT model, cnt AS r, count(*) AS n_r FROM cnts WHERE ord = {n} GROUP BY ALL),
nb AS (SELECT model, r, n_r, coalesce(lag(r) OVER w, 0) AS q, lead(r) OVER w AS t FROM nr WINDOW w AS (PARTITION BY model ORDER BY r)),
z AS (SELECT model, r, n_r, ln(r) AS x, ln(CASE WHEN t IS NULL THEN n_r / (r - q)::DOUBLE ELSE n_r / (0.5 * (t - q)) END) AS y FROM nb),
fit AS (SELECT model, coalesce(regr_slope(y, x), max(y / (x * x + 1)) * max(x)) AS slope, coalesce(regr_intercept(y, x), max(y / (x * x + 1))) AS intercept,
        count(*) AS points, sum(r * n_r)::BIGINT AS total, exp(coalesce(regr_intercept(y, x), max(y / (x * x + 1)))) / sum(r * n_r) AS p0 FROM z GROUP BY model),
gt AS MATERIALIZED (SELECT c.model, gram, cnt, gram[1:{n - 1}] AS ctx, p0,
       exp(ln(cnt + 1) + slope * ln(cnt + 1) - slope * ln(cnt) - ln(total)) AS p FROM cnts c JOIN fit f ON c.model = f.model WHERE ord = {n}),
gctx AS MATERIALIZED (SELECT g.model, ctx, sum(p) + (max(v) - count(*)) * max(p0) AS z FROM gt g JOIN vsize s ON g.model = s.model GROUP BY g.model, ctx)"""


def good_turing_fit(n: int) -> str:
    return f"WITH {model_base(n)}, {good_turing(n)} SELECT model, round(slope, 6) AS slope, round(intercept, 6) AS intercept, points, total FROM fit"


def good_turing_probs(n: int) -> str:
    base = ", ".join([seqs(), pads(n), counts_of(n), vocab(n)])
    z = "(sum(p) OVER w + (v - count(*) OVER w) * p0)"
    return (
        f"WITH {base}, {good_turing(n)} SELECT model, array_to_string(gram, ' ') AS gram, cnt, {r6(neglog('(p / z)'))} AS nlp "
        f"FROM (SELECT g.model, gram, cnt, p, {z} AS z FROM gt g JOIN vsize s ON g.model = s.model WINDOW w AS (PARTITION BY g.model, ctx))"
    )


def perplexity_good_turing(n: int) -> str:
    scored = (
        f"SELECT t.model, times, CASE WHEN g.p IS NOT NULL THEN {neglog('(g.p / x.z)')} WHEN x.z IS NOT NULL THEN {neglog('(f.p0 / x.z)')} ELSE ln(v) END AS nlp "
        f"FROM test t LEFT JOIN gctx x ON x.model = t.model AND x.ctx = t.gram[1:{n - 1}] LEFT JOIN gt g ON g.model = t.model AND g.gram = t.gram "
        "JOIN fit f ON f.model = t.model JOIN vsize s ON s.model = t.model"
    )
    return _perplexity(f"{model_base(n)}, {good_turing(n)}, {test_windows(n)}", scored)


def katz(n: int, k: int = 5, reserved: float = 0.01) -> str:
    clamp = lambda x: f"greatest(least({x}, 1.0), 1e-9)"
    parts = [f"""spec AS (SELECT model, ord, cnt AS r, count(*) AS n_r FROM cnts WHERE ord > 1 GROUP BY ALL),
tops AS (SELECT model, ord, max(r) AS top FROM spec GROUP BY ALL),
grid AS (SELECT model, ord, top, unnest(range(1, {k + 2})) AS r FROM tops),
nfull AS (SELECT g.model, g.ord, g.r, CASE WHEN g.r <= top THEN coalesce(n_r, 0)::DOUBLE ELSE 1e-9 END AS n_r FROM grid g LEFT JOIN spec s ON g.model = s.model AND g.ord = s.ord AND g.r = s.r),
ends AS (SELECT model, ord, max(n_r) FILTER (WHERE r = 1) AS n1, max(n_r) FILTER (WHERE r = {k + 1}) AS nk FROM nfull GROUP BY ALL),
disc AS (SELECT a.model, a.ord, a.r, coalesce({clamp('''((a.r + 1) * b.n_r / nullif(a.n_r * a.r, 0) - K * nk / nullif(n1, 0)) / nullif(1 - K * nk / nullif(n1, 0), 0)'''.replace('K', str(k + 1)))}, 1.0) AS d
         FROM nfull a JOIN nfull b ON a.model = b.model AND a.ord = b.ord AND b.r = a.r + 1 JOIN ends e ON e.model = a.model AND e.ord = a.ord),
tot AS (SELECT model, sum(cnt) AS total FROM cnts WHERE ord = 1 GROUP BY model),
k1 AS (SELECT c.model, gram, cnt, {1 - reserved} * cnt / total AS p FROM cnts c JOIN tot t ON c.model = t.model WHERE ord = 1)"""]
    for m in range(2, n + 1):
        parts.append(f"""x{m} AS (SELECT model, gram[1:{m - 1}] AS ctx, sum(cnt) AS ctx_cnt FROM cnts WHERE ord = {m} GROUP BY ALL),
k{m} AS (SELECT c.model, c.gram, c.cnt, coalesce(d, 1.0) * c.cnt / ctx_cnt AS p FROM cnts c JOIN x{m} x ON x.model = c.model AND x.ctx = c.gram[1:{m - 1}]
        LEFT JOIN disc ON disc.model = c.model AND disc.ord = c.ord AND disc.r = c.cnt WHERE c.ord = {m}),
b{m} AS (SELECT h.model, h.gram[1:{m - 1}] AS ctx, sum(h.p) AS hi, sum(coalesce(l.p, 0)) AS lo FROM k{m} h LEFT JOIN k{m - 1} l ON l.model = h.model AND l.gram = h.gram[2:{m}] GROUP BY ALL),
a{m} AS (SELECT model, ctx, {neglog(f"({clamp('1 - hi')} / {clamp('1 - lo')})")} AS nla FROM b{m})""")
    units = f"SELECT model, 1 AS ord, gram, cnt, p FROM k1 WHERE gram <> ['<unk>'] UNION ALL SELECT DISTINCT model, 1 AS ord, ['<unk>'] AS gram, 0 AS cnt, {reserved}::DOUBLE AS p FROM cnts"
    rest = "".join(f" UNION ALL SELECT model, {m} AS ord, gram, cnt, p FROM k{m}" for m in range(2, n + 1))
    parts.append(f"kp AS (SELECT model, ord, gram, cnt, {neglog('p')} AS nlp FROM ({units}{rest}))")
    return ",\n".join(parts)


def katz_discounts(n: int) -> str:
    return f"WITH {model_base(n)}, {katz(n)} SELECT model, ord, r, round(d, 6) AS d FROM disc"


def katz_probs(n: int) -> str:
    return f"WITH {model_base(n)}, {katz(n)} SELECT model, ord, array_to_string(gram, ' ') AS gram, CAST(cnt AS BIGINT) AS cnt, {r6('nlp')} AS nlp FROM kp"


def katz_backoffs(n: int) -> str:
    union = " UNION ALL ".join(f"SELECT model, {m} AS ord, array_to_string(ctx, ' ') AS ctx, {r6('nla')} AS nla FROM a{m}" for m in range(2, n + 1))
    return f"WITH {model_base(n)}, {katz(n)} {union}"


def perplexity_katz(n: int) -> str:
    joins, cases, carried = "", "", "0"
    for m in range(n, 0, -1):
        tail = f"t.gram[{n - m + 1}:{n}]"
        joins += f" LEFT JOIN (SELECT * FROM kp WHERE ord = {m}) p{m} ON p{m}.model = t.model AND p{m}.gram = {tail}"
        cases += f" WHEN p{m}.nlp IS NOT NULL THEN {carried} + p{m}.nlp"
        if m > 1:
            joins += f" LEFT JOIN a{m} ON a{m}.model = t.model AND a{m}.ctx = t.gram[{n - m + 1}:{n - 1}]"
            carried += f" + coalesce(a{m}.nla, 0)"
    return _perplexity(f"{model_base(n)}, {katz(n)}, {test_windows(n)}", f"SELECT t.model, times, CASE{cases} ELSE 'inf'::DOUBLE END AS nlp FROM test t{joins}")


def oov_rate(n: int) -> str:
    tests = f"tseq AS (SELECT m.model, {TOKENS} AS toks FROM benchmark CROSS JOIN (SELECT DISTINCT model FROM seq) m)"
    return (
        f"WITH {seqs()}, {pads(n)}, {counts(n)}, {tests}, {pads(n, 'tpad', 'tseq')}, t AS (SELECT DISTINCT model, gram FROM ({grams(n, 'tpad')})) "
        f"SELECT t.model, CAST(count(*) FILTER (WHERE c.gram IS NULL) AS BIGINT) AS unseen, count(*) AS distinct_grams, "
        f"round(100 * count(*) FILTER (WHERE c.gram IS NULL) / count(*)::DOUBLE, 6) AS rate "
        f"FROM t LEFT JOIN (SELECT * FROM cnts WHERE ord = {n}) c ON c.model = t.model AND c.gram = t.gram GROUP BY t.model"
    )


SAMPLES = "sig AS (SELECT user_id, list(value ORDER BY ts, event_id) AS s FROM events WHERE value IS NOT NULL GROUP BY user_id)"
EMPHASIS = "emp AS (SELECT user_id, list_transform(s, lambda x, i: x - CASE WHEN i > 1 THEN 0.95 * s[i - 1] ELSE 0 END) AS s FROM sig)"


def frames(length: int, step: int) -> str:
    count = f"(CASE WHEN len(s) - 1 >= {length} THEN (len(s) - 1 - {length}) // {step} + 1 ELSE 0 END + 1)"
    w = f"(0.54 - 0.46 * cos(2 * pi() * j / {length - 1}))"
    return (
        f"{SAMPLES}, {EMPHASIS}, fr AS (SELECT user_id, f AS frame_no, list_transform(range(0, {length}), lambda j: "
        f"CASE WHEN f * {step} + j + 1 <= len(s) - 1 THEN s[f * {step} + j + 1] * {w} ELSE 0.0 END) AS frame FROM (SELECT user_id, s, unnest(range(0, {count})) AS f FROM emp))"
    )


def spectrum(length: int, step: int, size: int) -> str:
    wave = lambda fn: f"list_sum(list_transform(range(0, {length}), lambda j: frame[j + 1] * {fn}(2 * pi() * b * j / {size})))"
    return f"{frames(length, step)}, ps AS (SELECT user_id, frame_no, list_transform(range(0, {size // 2 + 1}), lambda b: (pow({wave('cos')}, 2) + pow({wave('sin')}, 2)) / {size}) AS power FROM fr)"


def _weights(rows) -> str:
    return "[" + ", ".join("[" + ", ".join(repr(float(x)) for x in r) + "]" for r in rows) + "]"


def mel(length: int, step: int, size: int, bank) -> str:
    energy = f"list_sum(list_transform(range(1, {size // 2 + 2}), lambda b: power[b] * row[b]))"
    return f"{spectrum(length, step, size)}, lm AS (SELECT user_id, frame_no, list_transform({_weights(bank)}, lambda row: ln(CASE WHEN {energy} = 0 THEN {2.0 ** -52} ELSE {energy} END)) AS mel FROM ps)"


def cepstra(length: int, step: int, size: int, bank, matrix) -> str:
    return f"{mel(length, step, size, bank)}, cc AS (SELECT user_id, frame_no, list_transform({_weights(matrix)}, lambda row: list_sum(list_transform(range(1, {len(bank) + 1}), lambda b: mel[b] * row[b]))) AS c FROM lm)"


def positions(ctes: str, table: str, column: str) -> str:
    return f"WITH {ctes} SELECT user_id, CAST(frame_no AS INT) AS frame_no, CAST(i - 1 AS INT) AS pos, round(v, 6) + 0.0 AS v FROM (SELECT user_id, frame_no, unnest({column}) AS v, generate_subscripts({column}, 1) AS i FROM {table})"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(("1e30" if math.isinf(x) else repr(x)) + "::DOUBLE" if isinstance(x, float) else repr(x) for x in r) + ")" for r in rows)
