"""The queries in SQL, each written apart from the DataFrame code."""
from __future__ import annotations

import re

SEQS = "seqs AS (SELECT doc_id AS seq_id, lang, regexp_replace(upper(text), '[^ACGT]+', '', 'g') AS seq FROM documents WHERE length(regexp_replace(upper(text), '[^ACGT]+', '', 'g')) >= 12)"
RC = "reverse(translate(seq, 'ACGT', 'TGCA'))"
TOP = "topc AS (SELECT {by} substr(seq, greatest(1, i - 2), least(i, 3)) AS w, count(*) AS n FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM seqs) GROUP BY ALL)"
CNT = "cnt AS (SELECT {by} k, right(w, k + 1) AS kmer, sum(n) AS n FROM (SELECT *, unnest(range(0, length(w))) AS k FROM topc) GROUP BY ALL)"


def counts(by: str = "") -> str:
    return f"{SEQS}, {TOP.format(by=by)}, {CNT.format(by=by)}"


LETTERS = "l(b) AS (VALUES ('A'), ('C'), ('G'), ('T')), km AS (SELECT 0 AS k, b AS kmer FROM l UNION ALL SELECT 1, x.b || y.b FROM l x, l y UNION ALL SELECT 2, x.b || y.b || z.b FROM l x, l y, l z)"


def model(g: str = "", lower: str = "p.v") -> str:
    """bg(g, k, kmer, n, v) of order 2; g: a grouping column."""
    c = f"{g}, " if g else ""
    groups = f", (SELECT DISTINCT {g} FROM cnt) gg" if g else ""
    eq = lambda a, b: f"{a}.{g} IS NOT DISTINCT FROM {b}.{g} AND " if g else ""
    gc = f"gg.{g}, " if g else ""
    gf = f"f.{g}, " if g else ""
    full = f"f AS (SELECT {gc} km.k, km.kmer, coalesce(cnt.n, 0) AS n FROM km {groups} LEFT JOIN cnt ON cnt.k = km.k AND cnt.kmer = km.kmer {f'AND cnt.{g} IS NOT DISTINCT FROM gg.{g}' if g else ''})"
    v0 = f"b0 AS (SELECT {c} k, kmer, n, (n + 0.25) / (sum(n) OVER ({f'PARTITION BY {g}' if g else ''}) + 1) AS v FROM f WHERE k = 0)"
    up = lambda k: f"b{k} AS (SELECT {gf} f.k, f.kmer, f.n, (f.n + 10 * {lower}) / (h.n + 10) AS v FROM f JOIN b{k - 1} p ON {eq('p', 'f')} p.kmer = right(f.kmer, {k}) JOIN b{k - 1} h ON {eq('h', 'f')} h.kmer = left(f.kmer, {k}) WHERE f.k = {k})"
    return f"{full}, {v0}, {up(1)}, {up(2)}, bg AS (SELECT * FROM b0 UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM b2)"


INDEX = "CAST(list_reduce(list_prepend(0, list_transform(string_split({k}, ''), lambda c: instr('ACGT', c) - 1)), lambda a, b: a * 4 + b) AS BIGINT)"
BG = f"{counts()}, {LETTERS}, {model()}"
kmer_count_k3 = f"WITH {counts()} SELECT CAST(k AS INT) AS k, kmer, CAST(n AS BIGINT) AS n FROM cnt"
base_freq = f"WITH {SEQS}, c AS (SELECT unnest(string_split(seq, '')) AS base FROM seqs) SELECT base, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS freq FROM c GROUP BY base"
base_codes = """WITH c AS (SELECT unnest(string_split(text, '')) AS c FROM documents), k AS (SELECT CAST(instr('ACGTMH', upper(c)) AS INT) AS code FROM c WHERE c <> '')
SELECT code, substr('NACGTMH', code + 1, 1) AS letter, substr('NTGCAGG', code + 1, 1) AS complement, count(*) AS n FROM k GROUP BY code"""
length_stats = f"WITH {SEQS} SELECT count(*) AS sequences, min(length(seq)) AS shortest, max(length(seq)) AS longest, CAST(sum(length(seq)) AS BIGINT) AS bases FROM seqs"
revcomp = f"WITH {SEQS} SELECT seq_id, {RC} AS rc FROM seqs"
double_strand = f"WITH {SEQS} SELECT seq_id, '+' AS strand, seq, length(seq) AS L FROM seqs UNION ALL SELECT seq_id, '-', {RC}, length(seq) FROM seqs"
doubled = f"WITH {SEQS} SELECT seq_id, seq || 'N' || {RC} AS dseq FROM seqs"
kmer_index = f"WITH {counts()} SELECT CAST(k AS INT) AS k, kmer, {INDEX.format(k='kmer')} AS y, {INDEX.format(k='kmer')} // 4 AS prefix, {INDEX.format(k='kmer')} % 4 AS suffix, CAST(n AS BIGINT) AS n FROM cnt"
kmer_rollup = f"WITH {counts()} SELECT CAST(k2 AS INT) AS k, right(kmer, k2 + 1) AS kmer, CAST(sum(n) AS BIGINT) AS n FROM cnt, (VALUES (0), (1), (2)) t(k2) WHERE k = 2 GROUP BY ALL"
seq_kmer_counts = f"""WITH {SEQS}, p AS (SELECT seq_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM seqs)
SELECT seq_id, 0 AS k, substr(seq, i, 1) AS kmer, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT seq_id, 1, substr(seq, i - 1, 2), count(*) FROM p WHERE i > 1 GROUP BY ALL"""
short_filter = "SELECT doc_id AS seq_id, 2 * n + 1 < 60 AS short_double, n < 60 AS short_single FROM (SELECT doc_id, length(regexp_replace(upper(text), '[^ACGT]+', '', 'g')) AS n FROM documents WHERE text IS NOT NULL)"
basename = "SELECT page_id, CASE WHEN strpos(b, '.') > 1 THEN regexp_replace(b, '\\.[^.]*$', '') ELSE b END AS name FROM (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS b FROM pages)"
cv_folds = f"WITH {SEQS}, r AS (SELECT seq_id, row_number() OVER (ORDER BY seq_id) - 1 AS idx FROM seqs) SELECT seq_id, idx, CAST(idx % 4 AS INT) AS fold FROM r"
bg_order2 = f"WITH {BG} SELECT CAST(k AS INT) AS k, kmer, {INDEX.format(k='kmer')} AS y, CAST(n AS BIGINT) AS n, round(v, 9) AS v FROM bg"
JOINT = "j1 AS (SELECT b1.kmer, b1.v * b0.v AS p FROM b1 JOIN b0 ON b0.kmer = left(b1.kmer, 1)), j2 AS (SELECT b2.kmer, b2.v * j1.p AS p FROM b2 JOIN j1 ON j1.kmer = left(b2.kmer, 2)), bj AS (SELECT 0 AS k, kmer, v AS p FROM b0 UNION ALL SELECT 1, kmer, p FROM j1 UNION ALL SELECT 2, kmer, p FROM j2)"
bg_joint = f"WITH {BG}, {JOINT} SELECT CAST(k AS INT) AS k, kmer, round(p, 9) AS p FROM bj"
bg_noninterp = f"WITH {counts()}, {LETTERS}, {model(lower='0.25')} SELECT CAST(k AS INT) AS k, kmer, round(v, 9) AS v FROM bg"
cdf_table = f"WITH {BG} SELECT CAST(k AS INT) AS k, kmer, round(sum(v) OVER (PARTITION BY k, left(kmer, length(kmer) - 1) ORDER BY kmer), 9) AS upto FROM bg"
LANGS = f"{counts('lang, ')}, {LETTERS}, {model('lang')}"
LLH = f"{LANGS}, llh AS (SELECT t.lang, bg.lang AS model, sum(t.n * ln(bg.v)) AS llh FROM topc t JOIN bg ON bg.kmer = t.w GROUP BY ALL)"
bg_loglik = f"WITH {LLH} SELECT lang, model, round(llh, 4) AS llh FROM llh"
POST = f"{LLH}, ex AS (SELECT *, CASE WHEN llh - max(llh) OVER w >= ln(1e-15) - ln(count(*) OVER w) THEN exp(llh - max(llh) OVER w) ELSE 0 END AS e FROM llh WINDOW w AS (PARTITION BY lang)), post AS (SELECT lang, model, llh, e / sum(e) OVER (PARTITION BY lang) AS posterior FROM ex)"
bg_posterior = f"WITH {POST} SELECT lang, model, round(posterior, 6) AS posterior FROM post"
bg_top2 = f"WITH {POST} SELECT lang, CAST(rank AS INT) AS rank, model, round(posterior, 6) AS posterior FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY posterior DESC, llh DESC, model) AS rank FROM post) WHERE rank <= 2"
seq_model = f"""WITH {LANGS}, sc AS (SELECT seq_id, substr(seq, greatest(1, i - 2), least(i, 3)) AS w, count(*) AS n FROM (SELECT seq_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM seqs) GROUP BY ALL),
s AS (SELECT seq_id, bg.lang AS model, sum(sc.n * ln(v)) AS llh FROM sc JOIN bg ON bg.kmer = sc.w GROUP BY ALL)
SELECT seq_id, model, round(llh, 4) AS llh FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY round(llh, 9) DESC, model DESC) AS r FROM s) WHERE r = 1"""
bg_pos_lik = f"WITH {BG} SELECT p.seq_id, CAST(p.i AS INT) AS i, round(bg.v, 6) AS lik FROM (SELECT seq_id, i, substr(seq, greatest(1, i - 2), least(i, 3)) AS w FROM (SELECT seq_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM seqs)) p JOIN bg ON bg.kmer = p.w"

SITES = f"{BG}, st AS (SELECT substr(seq, i, 10) AS site FROM (SELECT seq, unnest(range(1, length(seq) - 8)) AS i FROM seqs) WHERE substr(seq, i, 3) = 'CAT')"
sites = f"WITH {SITES} SELECT site, count(*) AS n FROM st GROUP BY site"
SC = f"{SITES}, sc AS (SELECT k, j, substr(site, j - k + 1, k + 1) AS kmer, count(*) AS n FROM (SELECT site, j, unnest(range(0, least(j, 2) + 1)) AS k FROM (SELECT site, unnest(range(0, 10)) AS j FROM st)) GROUP BY ALL)"
site_counts = f"WITH {SC} SELECT CAST(k AS INT) AS k, CAST(j AS INT) AS j, kmer, n FROM sc"
MV = f"""{SC}, mf AS (SELECT km.k, t.j, km.kmer, coalesce(sc.n, 0) AS n FROM km, (SELECT unnest(range(0, 10)) AS j) t LEFT JOIN sc ON sc.k = km.k AND sc.j = t.j AND sc.kmer = km.kmer),
m0 AS (SELECT mf.j, mf.kmer, mf.n, (mf.n + b0.v) / (sum(mf.n) OVER (PARTITION BY j) + 1) AS v FROM mf JOIN b0 ON b0.kmer = mf.kmer WHERE mf.k = 0),
m1 AS (SELECT mf.j, mf.kmer, mf.n, CASE WHEN mf.j < 1 THEN s.v ELSE (mf.n + 21 * s.v) / (h.n + 21) END AS v FROM mf JOIN m0 s ON s.j = mf.j AND s.kmer = right(mf.kmer, 1) LEFT JOIN m0 h ON h.j = mf.j - 1 AND h.kmer = left(mf.kmer, 1) WHERE mf.k = 1),
m2 AS (SELECT mf.j, mf.kmer, mf.n, CASE WHEN mf.j < 2 THEN s.v ELSE (mf.n + 63 * s.v) / (h.n + 63) END AS v FROM mf JOIN m1 s ON s.j = mf.j AND s.kmer = right(mf.kmer, 2) LEFT JOIN m1 h ON h.j = mf.j - 1 AND h.kmer = left(mf.kmer, 2) WHERE mf.k = 2),
mv AS (SELECT 0 AS k, * FROM m0 UNION ALL SELECT 1, * FROM m1 UNION ALL SELECT 2, * FROM m2)"""
motif_v = f"WITH {MV} SELECT CAST(k AS INT) AS k, CAST(j AS INT) AS j, kmer, round(v, 9) AS v FROM mv"
MP = f"""{MV}, p1 AS (SELECT m1.j, m1.kmer, CASE WHEN m1.j < 1 THEN b0.v * m1.v ELSE m1.v * m0.v END AS p FROM m1 JOIN b0 ON b0.kmer = left(m1.kmer, 1) LEFT JOIN m0 ON m0.j = m1.j - 1 AND m0.kmer = left(m1.kmer, 1)),
p2 AS (SELECT m2.j, m2.kmer, CASE m2.j WHEN 0 THEN b0.v * b1.v * m2.v WHEN 1 THEN b0.v * x.v * m2.v ELSE m2.v * p1.p END AS p
  FROM m2 JOIN b0 ON b0.kmer = left(m2.kmer, 1) JOIN b1 ON b1.kmer = left(m2.kmer, 2) JOIN m1 x ON x.j = 0 AND x.kmer = left(m2.kmer, 2) LEFT JOIN p1 ON p1.j = m2.j - 1 AND p1.kmer = left(m2.kmer, 2)),
mp AS (SELECT 0 AS k, j, kmer, v AS p FROM m0 UNION ALL SELECT 1, * FROM p1 UNION ALL SELECT 2, * FROM p2)"""
motif_p = f"WITH {MP} SELECT CAST(k AS INT) AS k, CAST(j AS INT) AS j, kmer, round(p, 9) AS p FROM mp"
LO = f"{MV}, lo AS (SELECT mv.kmer, mv.j, ln(mv.v + 1e-5) - ln(bg.v) AS s FROM mv JOIN bg ON bg.kmer = mv.kmer)"
logodds_table = f"WITH {LO} SELECT kmer, CAST(j AS INT) AS j, round(s, 6) AS s FROM lo"
info_content = f"WITH {MV} SELECT CAST(j AS INT) AS j, round(CASE WHEN min(v) > 0 THEN 2 + sum(v * log2(v)) ELSE 0 END, 6) AS bits FROM m0 GROUP BY j"
KC = f"""{MP}, kc AS (SELECT 0 AS k, j, kmer, v * log2(v / 0.25) AS bits FROM m0 UNION ALL
SELECT mp.k, mp.j, mp.kmer, mp.p * log2(h.v / s.v) FROM mp JOIN mv h ON h.k = mp.k AND h.j = mp.j AND h.kmer = mp.kmer JOIN mv s ON s.k = mp.k - 1 AND s.j = mp.j AND s.kmer = right(mp.kmer, mp.k) WHERE mp.k > 0 AND mp.j >= mp.k)"""
kmer_contrib = f"WITH {KC} SELECT CAST(k AS INT) AS k, CAST(j AS INT) AS j, kmer, round(bits, 9) AS bits FROM kc"
contrib_totals = f"WITH {KC} SELECT CAST(k AS INT) AS k, CAST(j AS INT) AS j, round(sum(bits), 6) AS bits, round(sum(greatest(bits, 0)), 6) AS plus, round(sum(least(bits, 0)), 6) + 0.0 AS minus FROM kc GROUP BY ALL"
bg_contrib = f"WITH {BG}, {JOINT} SELECT 0 AS k, kmer, round(v * log2(v / 0.25), 9) AS bits FROM b0 UNION ALL SELECT CAST(bj.k AS INT), bj.kmer, round(bj.p * log2(h.v / s.v), 9) FROM bj JOIN bg h ON h.kmer = bj.kmer JOIN bg s ON s.kmer = right(bj.kmer, bj.k) WHERE bj.k > 0"
logo_layout = f"""WITH {KC}, s AS (SELECT k, j, kmer, CASE WHEN bits >= 0 THEN 1 ELSE -1 END AS sign, abs(bits) AS h FROM kc),
w AS (SELECT *, coalesce(sum(h) OVER (PARTITION BY k, j, sign ORDER BY h, kmer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, count(*) OVER (PARTITION BY k, j, sign) AS n FROM s)
SELECT CAST(k AS INT) AS k, CAST(j AS INT) AS j, CAST(sign AS INT) AS sign, max(round(base + h * greatest(0, 1 - n * 0.01), 6)) AS top, count(*) AS letters FROM w GROUP BY ALL"""
iupac = f"""WITH {MV}, i(o, letter, bases) AS (VALUES (0,'A','A'),(1,'C','C'),(2,'G','G'),(3,'T','T'),(4,'S','CG'),(5,'W','AT'),(6,'R','AG'),(7,'Y','CT'),(8,'M','AC'),(9,'K','GT'),(10,'N','')),
raw AS (SELECT o, letter, b, 0.2 * CASE WHEN b IN ('A', 'T') THEN 0.2 ELSE 0.3 END + CASE WHEN contains(bases, b) THEN 0.7 ELSE 0 END AS x FROM i, l),
pr AS (SELECT o, letter, b, x / sum(x) OVER (PARTITION BY o) AS f FROM raw),
d AS (SELECT j, o, letter, round(sum((v - f) * (log2(v) - log2(f))), 9) AS d FROM (SELECT j, kmer, greatest(v, 1e-12) AS v FROM m0) m JOIN pr ON pr.b = m.kmer GROUP BY ALL)
SELECT CAST(j AS INT) AS j, letter FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY d, o) AS r FROM d) WHERE r = 1"""
pwm_entropy = f"WITH {MV} SELECT CAST(j AS INT) AS j, round(sum(v * log2(v)) / 2, 6) AS h_model, round((sum(v * log2(v)) + sum(0.25 * log2(0.25))) / 2 - sum((v + 0.25) / 2 * log2((v + 0.25) / 2)), 6) AS h_model_bg FROM m0 GROUP BY j"
pwm_revcomp = f"WITH {MV} SELECT CAST(9 - j AS INT) AS j, translate(kmer, 'ACGT', 'TGCA') AS kmer, round(v, 9) AS v FROM m0"

DS = f"ds AS (SELECT seq_id, length(seq) AS L, seq || 'N' || {RC} AS dseq FROM seqs)"
POS = f"{DS}, ps AS (SELECT seq_id, L, i, regexp_extract(substr(dseq, greatest(1, i - 2), least(i, 3)), '[^N]*$') AS w FROM (SELECT *, unnest(range(1, length(dseq) + 1)) AS i FROM ds))"
WIN = f"{LO}, {POS}, win AS (SELECT seq_id, any_value(L) AS L, i - 1 - j AS start, sum(s) AS score FROM ps JOIN lo ON lo.kmer = ps.w WHERE i - 1 - j >= 0 GROUP BY seq_id, i - 1 - j HAVING count(*) = 10)"
window_scores = f"WITH {WIN} SELECT seq_id, count(*) AS windows, round(avg(score), 6) AS mean, round(min(score), 6) AS low, round(max(score), 6) AS high FROM win GROUP BY seq_id"
zoops_best = f"WITH {WIN} SELECT seq_id, round(max(score), 6) AS score, count(*) AS windows FROM win GROUP BY seq_id"
motif_cross = f"""WITH {WIN}, l0 AS (SELECT m0.kmer, m0.j, ln(m0.v + 1e-5) - ln(b0.v) AS s FROM m0 JOIN b0 ON b0.kmer = m0.kmer),
w0 AS (SELECT seq_id, i - 1 - j AS start, sum(s) AS score FROM ps JOIN l0 ON l0.kmer = right(ps.w, 1) WHERE i - 1 - j >= 0 GROUP BY seq_id, i - 1 - j HAVING count(*) = 10),
b AS (SELECT 0 AS motif_id, seq_id, max(score) AS s, count(*) AS n FROM win GROUP BY seq_id UNION ALL SELECT 1, seq_id, max(score), count(*) FROM w0 GROUP BY seq_id)
SELECT motif_id, count(*) AS sequences, CAST(sum(n) AS BIGINT) AS windows, round(avg(s), 6) AS mean_best FROM b GROUP BY motif_id"""
frequent_windows = f"WITH {WIN} SELECT CASE WHEN start < win.L THEN '+' ELSE '-' END AS strand, substr(dseq, start + 1, 10) AS pattern, count(*) AS n, min(start + 1) AS first, max(start + 10) AS last FROM win JOIN ds USING (seq_id) WHERE score > 3 GROUP BY ALL"
Z = f"{WIN}, z AS (SELECT seq_id AS id, round(max(score), 9) AS score, CAST(1 - seq_id % 2 AS INT) AS is_pos FROM win GROUP BY seq_id)"
TAIL = f"{Z}, nr AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS r, count(*) OVER () AS m FROM z WHERE is_pos = 0), tl AS (SELECT m, greatest(1, least(100, m // 10)) AS n_top, min(score) AS s_top, avg(score) - min(score) AS rate FROM nr WHERE r <= greatest(1, least(100, m // 10)) GROUP BY m)"
neg_lambda = f"WITH {TAIL} SELECT m, n_top, round(s_top, 6) AS s_top, round(rate, 6) AS rate FROM tl"
PV = f"""{TAIL}, pv AS (SELECT id, least(1, CASE WHEN p.score > s_top THEN n_top * exp((s_top - p.score) / greatest(rate, 1e-12)) / m ELSE (SELECT count(*) FROM z n WHERE n.is_pos = 0 AND n.score >= p.score) / m END) AS p_value,
  (SELECT count(*) FROM z WHERE is_pos = 1) AS n FROM z p, tl WHERE p.is_pos = 1)"""
occurrence_pvalue = f"WITH {PV} SELECT id, round(p_value, 9) AS p_value, round(p_value * n, 6) AS e_value FROM pv"
occurrences = f"WITH {PV} SELECT id, round(p_value, 9) AS p_value FROM pv WHERE p_value < 0.05"
MID = f"{Z}, mr AS (SELECT id, least(1, greatest(1e-6, 1 - ((SELECT count(*) FROM z n WHERE n.is_pos = 0 AND n.score < p.score) + (SELECT count(*) FROM z n WHERE n.is_pos = 0 AND n.score <= p.score)) / (2 * (SELECT count(*) FROM z WHERE is_pos = 0)))) AS p_value FROM z p WHERE is_pos = 1)"
midrank_pvalue = f"WITH {MID} SELECT id, round(p_value, 9) AS p_value FROM mr"
pvalue_hist = f"WITH {MID} SELECT CAST(least(29, floor(round(p_value * 30, 6))) AS INT) AS bin, count(*) AS n FROM mr GROUP BY 1"
CURVE = f"{Z}, cv AS (SELECT id, score, is_pos, row_number() OVER w AS rank, sum(is_pos) OVER w AS tp, sum(1 - is_pos) OVER w AS fp, sum(is_pos) OVER () AS pos FROM z WINDOW w AS (ORDER BY score DESC, is_pos, id ROWS UNBOUNDED PRECEDING)), c AS (SELECT id, is_pos, rank, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, fp / (tp + fp) AS fdr, tp / pos AS recall, pos FROM cv)"
zoops_curve = f"WITH {CURVE} SELECT id, rank, tp, fp, round(fdr, 9) AS fdr, round(recall, 9) AS recall FROM c"
mops_curve = f"""WITH {WIN}, a AS (SELECT {{'seq_id': seq_id, 'start': start}} AS id, round(score, 6) AS score, 1 - seq_id % 2 AS is_pos FROM win),
r AS (SELECT id, score, row_number() OVER w AS rank, sum(is_pos) OVER w - sum(1 - is_pos) OVER w AS tp, sum(1 - is_pos) OVER w AS fp FROM a WINDOW w AS (ORDER BY score DESC, is_pos, id ROWS UNBOUNDED PRECEDING)),
k AS (SELECT * FROM r WHERE rank <= (SELECT max(rank) FROM r WHERE tp = (SELECT max(tp) FROM r)))
SELECT CAST(floor(score * 2) AS BIGINT) AS bin, count(*) AS n, CAST(max(tp) AS DOUBLE) AS tp, CAST(max(fp) AS DOUBLE) AS fp FROM k GROUP BY 1"""


def trapezoid(points: str, x: str, y: str, order: str, scale: str, name: str) -> str:
    return f"WITH {CURVE}, pt AS ({points}) SELECT round(sum(({x} - px) * ({y} + py) / 2) {scale}, 6) AS {name} FROM (SELECT *, lag({x}) OVER (ORDER BY {order}) AS px, lag({y}) OVER (ORDER BY {order}) AS py FROM pt)"


auprc = trapezoid("SELECT recall, tp / (tp + fp) AS y, rank FROM c", "recall", "y", "rank", "", "auprc")
pauc = trapezoid("SELECT * FROM (SELECT fp / (SELECT max(fp) FROM c) AS x, recall AS y, rank FROM c) WHERE x <= 0.05", "x", "y", "rank", "/ 0.05", "pauc")
avrec = trapezoid("SELECT recall, log10(greatest(1, least(100, CASE WHEN fp > 0 THEN tp / fp ELSE 100 END))) AS y, rank FROM c", "recall", "y", "rank", "/ 2", "avrec")
ausfc = trapezoid("SELECT log10(fdr) AS x, max(recall) AS y FROM c WHERE fdr >= 0.01 AND fdr <= 0.5 GROUP BY fdr", "x", "y", "x", "/ (log10(0.5) - log10(0.01))", "ausfc")
occ_frac = f"WITH {CURVE} SELECT round(1 - max(fp) / pos, 6) AS occ_frac FROM c WHERE tp = floor(pos * 0.3) GROUP BY pos"
occ_mult = f"""WITH {WIN}, a AS (SELECT seq_id, start, round(score, 6) AS score, 1 - seq_id % 2 AS is_pos FROM win)
SELECT round(max(tp) / (SELECT count(*) FROM seqs WHERE seq_id % 2 = 0), 6) AS occ_mult FROM (SELECT sum(2 * is_pos - 1) OVER (ORDER BY score DESC, is_pos, seq_id, start ROWS UNBOUNDED PRECEDING) AS tp FROM a)"""
FIRST = f"{WIN}, fb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY round(score, 9) DESC, start) AS r FROM win) WHERE r = 1)"
position_hist = f"WITH {FIRST} SELECT CASE WHEN start < L THEN '+' ELSE '-' END AS strand, CAST(floor((floor(CASE WHEN start < L THEN start ELSE start - L - 1 END + 5) - floor(L / 2)) / 50) AS BIGINT) AS bin, count(*) AS n FROM fb GROUP BY ALL"
bed_coords = f"""WITH {WIN}, h AS (SELECT seq_id, L, start, CASE WHEN start < L THEN '+' ELSE '-' END AS strand, CASE WHEN start < L THEN start + 1 ELSE 2 * L - (start + 10 - 1) + 1 END AS f FROM win WHERE score > 5)
SELECT 'chr' || (seq_id % 7) AS chrom, strand, count(*) AS n, CAST(sum(seq_id * 1000 + f - 1) AS BIGINT) AS starts, CAST(sum(seq_id * 1000 + f + 9) AS BIGINT) AS ends FROM h GROUP BY ALL"""
ES = f"""{MV}, {POS}, lr AS (SELECT mv.kmer, mv.j, ln(mv.v) - ln(bg.v) AS s FROM mv JOIN bg ON bg.kmer = mv.kmer),
wo AS (SELECT seq_id, i - 1 - j AS start, exp(sum(s)) AS odds FROM ps JOIN lr ON lr.kmer = ps.w WHERE i - 1 - j >= 0 GROUP BY seq_id, i - 1 - j HAVING count(*) = 10),
nm AS (SELECT seq_id, count(*) AS n, 0.7 + 0.3 / count(*) * sum(odds) AS norm FROM wo GROUP BY seq_id),
rs AS (SELECT seq_id, start, 0.3 / n * odds / norm AS r FROM wo JOIN nm USING (seq_id))"""
estep_r = f"WITH {ES} SELECT seq_id, count(*) AS n, round(sum(r), 5) AS r FROM rs WHERE r >= 0.05 GROUP BY seq_id"
em_llh = f"WITH {ES} SELECT (SELECT round(sum(ln(norm)), 4) FROM nm) AS llh, (SELECT round(sum(r), 4) FROM rs) AS total, (SELECT count(*) FROM nm) AS sequences"
mstep_counts = f"""WITH {ES}, e AS (SELECT j, w, sum(r) AS n FROM (SELECT rs.seq_id, rs.start, rs.r, unnest(range(0, 10)) AS j FROM rs) x JOIN ps ON ps.seq_id = x.seq_id AND ps.i = x.start + x.j + 1 GROUP BY ALL),
u AS (SELECT k, j, right(w, k + 1) AS kmer, sum(n) AS n FROM (SELECT *, unnest(range(0, length(w))) AS k FROM e) GROUP BY ALL)
SELECT CAST(k AS INT) AS k, CAST(j AS INT) AS j, kmer, round(n, 4) AS n FROM u WHERE n >= 0.05"""
mask_seqs = f"""WITH {SEQS}, p AS (SELECT seq_id, i, substr(seq, i, 1) AS c FROM (SELECT seq_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM seqs)),
h AS (SELECT DISTINCT seq_id, unnest(range(i, i + 10)) AS i FROM (SELECT seq_id, seq, unnest(range(1, length(seq) - 8)) AS i FROM seqs) WHERE substr(seq, i, 3) = 'CAT')
SELECT seq_id, string_agg(CASE WHEN h.i IS NULL THEN c ELSE 'N' END, '' ORDER BY p.i) AS seq FROM p LEFT JOIN h USING (seq_id, i) GROUP BY seq_id"""
pwm_similarity = f"""WITH {SEQS}, {LETTERS}, st AS (SELECT lang, substr(seq, i, 10) AS site FROM (SELECT lang, seq, unnest(range(1, length(seq) - 8)) AS i FROM seqs) WHERE substr(seq, i, 3) = 'CAT'),
c AS (SELECT lang, j, substr(site, j + 1, 1) AS b, count(*) AS n FROM (SELECT lang, site, unnest(range(0, 10)) AS j FROM st) GROUP BY ALL),
g AS (SELECT lang, j, l.b FROM (SELECT DISTINCT lang FROM st), (SELECT unnest(range(0, 10)) AS j), l),
m AS (SELECT g.lang, g.j, g.b, (coalesce(c.n, 0) + 0.25) / sum(coalesce(c.n, 0) + 0.25) OVER (PARTITION BY g.lang, g.j) AS p FROM g LEFT JOIN c ON c.lang = g.lang AND c.j = g.j AND c.b = g.b),
w AS (SELECT '+' AS s, * FROM m UNION ALL SELECT '-', lang, 9 - j, translate(b, 'ACGT', 'TGCA'), p FROM m),
d AS (SELECT x.lang AS a, y.lang AS b, y.s, x.j AS i, y.j AS j, sum(x.p * log2(x.p)) AS hx, sum(y.p * log2(y.p)) AS hy, sum((x.p + y.p) / 2 * log2((x.p + y.p) / 2)) AS hm, sum((x.p + 0.25) / 2 * log2((x.p + 0.25) / 2)) AS xb, sum((y.p + 0.25) / 2 * log2((y.p + 0.25) / 2)) AS yb FROM m x JOIN w y ON x.b = y.b GROUP BY ALL),
o AS (SELECT a, b, s, i - j AS at, 0.4 * (sum(0.5 * (hx - 2) - xb) + sum(0.5 * (hy - 2) - yb)) - sum(0.5 * (hx + hy) - hm) AS score FROM d GROUP BY ALL HAVING count(*) >= 2)
SELECT a, b, round(max(score), 6) AS sim_score FROM o GROUP BY a, b"""
exemplars = "SELECT source, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r = 1"

EU = """e AS (SELECT j, w, sum(r) AS n FROM (SELECT rs.seq_id, rs.start, rs.r, unnest(range(0, 10)) AS j FROM rs) x JOIN ps ON ps.seq_id = x.seq_id AND ps.i = x.start + x.j + 1 GROUP BY ALL),
u AS (SELECT k, j, right(w, k + 1) AS kmer, sum(n) AS n FROM (SELECT *, unnest(range(0, length(w))) AS k FROM e) GROUP BY ALL)"""
NEXT = MV.removeprefix(f"{SC}, ")  # the conditionals of the counts u, as nv
for _old, _new in (("sc", "u"), ("mf", "nf"), ("m0", "n0"), ("m1", "n1"), ("m2", "n2"), ("mv", "nv")):
    NEXT = re.sub(rf"\b{_old}\b", _new, NEXT)
_SHOW = "SELECT CAST(k AS INT) AS k, CAST(j AS INT) AS j, kmer, round(v, 6) AS v FROM nv"
em_step = f"WITH {ES}, {EU}, {NEXT} {_SHOW}"
CELLS = f"""{MV}, {POS}, l0 AS (SELECT m0.kmer, m0.j, ln(m0.v) - ln(b0.v) AS s FROM m0 JOIN b0 ON b0.kmer = m0.kmer),
w0 AS (SELECT seq_id, i - 1 - j AS start, exp(sum(s)) AS odds FROM ps JOIN l0 ON l0.kmer = right(ps.w, 1) WHERE i - 1 - j >= 0 GROUP BY seq_id, i - 1 - j HAVING count(*) = 10),
z0 AS (SELECT seq_id, count(*) AS n, 0.7 + 0.3 / count(*) * sum(odds) AS norm FROM w0 GROUP BY seq_id),
r0 AS (SELECT seq_id, start, n, round(0.3 / n * odds / norm * 1e12) AS u FROM w0 JOIN z0 USING (seq_id)),
ct AS (SELECT min(u) AS c FROM (SELECT u, row_number() OVER (ORDER BY u DESC) AS r, count(*) OVER () AS total FROM r0) WHERE r <= floor(total * 0.05) + 1),
cells AS (SELECT seq_id, start, n FROM r0, ct WHERE u >= c)"""
em_masked_cells = f"WITH {CELLS} SELECT seq_id, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts FROM cells GROUP BY seq_id"
em_masked_step = f"""WITH {CELLS}, lr AS (SELECT mv.kmer, mv.j, ln(mv.v) - ln(bg.v) AS s FROM mv JOIN bg ON bg.kmer = mv.kmer),
wo AS (SELECT seq_id, start, any_value(n) AS n, exp(sum(s)) AS odds FROM (SELECT *, unnest(range(0, 10)) AS j FROM cells) x JOIN ps USING (seq_id) JOIN lr ON lr.kmer = ps.w AND lr.j = x.j WHERE ps.i = x.start + x.j + 1 GROUP BY seq_id, start),
nm AS (SELECT seq_id, 0.7 + sum(0.3 / n * odds) AS norm FROM wo GROUP BY seq_id), rs AS (SELECT seq_id, start, 0.3 / n * odds / norm AS r FROM wo JOIN nm USING (seq_id)),
{EU}, {NEXT} {_SHOW}"""


def _fold(k: int) -> str:
    """Scores of fold ``k`` by the motif of the other folds' positives."""
    chain = WIN.replace("FROM seqs) WHERE substr(seq, i, 3)", "FROM tr) WHERE substr(seq, i, 3)").replace("AS dseq FROM seqs)", "AS dseq FROM te)")
    folds = "fo AS (SELECT *, (row_number() OVER (ORDER BY seq_id) - 1) % 4 AS fold FROM seqs)"
    parts = f"{folds}, tr AS (SELECT * FROM fo WHERE fold <> {k} AND seq_id % 2 = 0), te AS (SELECT * FROM fo WHERE fold = {k})"
    chain = chain.replace(f"{SEQS}, ", f"{SEQS}, {parts}, ", 1)
    return f"(WITH {chain} SELECT seq_id AS id, round(max(score), 9) AS score, CAST(1 - seq_id % 2 AS INT) AS is_pos FROM win GROUP BY seq_id)"


CV = " UNION ALL ".join(_fold(k) for k in range(4))
cv_scores = f"SELECT id, round(score, 6) AS score, is_pos FROM ({CV})"
cv_curve = f"WITH z AS ({CV}), {CURVE.removeprefix(f'{Z}, ')} SELECT id, rank, tp, fp, round(fdr, 9) AS fdr, round(recall, 9) AS recall FROM c"
curve_pvalue = f"""WITH {TAIL}, nb AS (SELECT id, score, is_pos, (SELECT count(*) FROM z n WHERE n.is_pos = 0 AND n.score >= z.score) AS above,
  coalesce((SELECT min(score) FROM z n WHERE n.is_pos = 0 AND n.score > z.score), score) AS up, coalesce((SELECT max(score) FROM z n WHERE n.is_pos = 0 AND n.score < z.score), score) AS lo FROM z)
SELECT id, is_pos, round(least(1, CASE WHEN score > s_top THEN n_top * exp((s_top - score) / greatest(rate, 1e-12)) / m ELSE (above + (up - score) / (up - lo + 1e-5)) / m END), 6) AS p_value FROM nb, tl"""
# the slope of the majorant over an interval: the least, over starts before it, of the steepest chord to an end after it
q_values = f"""WITH {MID}, d AS (SELECT round(p_value, 9) AS p, count(*) AS n FROM mr GROUP BY 1), gf AS (SELECT p, n, row_number() OVER (ORDER BY p) AS i, sum(n) OVER (ORDER BY p) / sum(n) OVER () AS y FROM d),
o AS (SELECT p, i, y FROM gf UNION ALL SELECT 0, 0, 0),
ch AS (SELECT a.i AS a, b.i AS b, max((b.y - a.y) / (b.p - a.p)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS m FROM o a JOIN o b ON b.i > a.i),
sl AS (SELECT gf.i, gf.p, gf.n, min(ch.m) AS slope FROM gf JOIN ch ON ch.b = gf.i AND ch.a < gf.i GROUP BY ALL),
mj AS (SELECT p, n, slope, sum(slope * (p - pp)) OVER (ORDER BY p) AS g FROM (SELECT *, lag(p, 1, 0) OVER (ORDER BY p) AS pp FROM sl))
SELECT p, CAST(n AS BIGINT) AS n, round(least(0.5 * p / g, 1), 6) AS q, round(least(0.5 / slope, 1), 6) AS lfdr FROM mj"""
bg_sample_shape = f"WITH {SEQS} SELECT seq_id, copy, length(seq) AS L, CAST(0 AS BIGINT) AS others FROM seqs, (VALUES (0), (1)) t(copy)"
raw_copies = f"WITH {SEQS} SELECT seq_id, copy, seq FROM seqs, (VALUES (0), (1)) t(copy)"

# one record per language, by letters: contexts come from the letters before, on each strand
RECORDS = """ch AS (SELECT rec AS seq_id, row_number() OVER (PARTITION BY rec ORDER BY seq_id, i) AS g, c FROM (SELECT coalesce(lang, '') AS rec, seq_id, unnest(range(1, length(seq) + 1)) AS i, unnest(string_split(seq, '')) AS c FROM seqs)),
rl AS (SELECT seq_id, count(*) AS L FROM ch GROUP BY seq_id),
sd AS (SELECT seq_id, L, g AS i, c FROM ch JOIN rl USING (seq_id) UNION ALL SELECT seq_id, L, 2 * L + 2 - g, translate(c, 'ACGT', 'TGCA') FROM ch JOIN rl USING (seq_id)),
ps AS (SELECT seq_id, L, i, coalesce(lag(c, 2) OVER w, '') || coalesce(lag(c) OVER w, '') || c AS w FROM sd WINDOW w AS (PARTITION BY seq_id, i > L ORDER BY i))"""
record_kmers = f"WITH {SEQS}, {RECORDS} SELECT seq_id, CAST(k AS INT) AS k, right(w, k + 1) AS kmer, count(*) AS n FROM (SELECT seq_id, w, unnest(range(0, length(w))) AS k FROM ps WHERE i <= L) GROUP BY ALL"
record_best = f"""WITH {WIN.replace(POS, RECORDS)}, b AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY round(score, 9) DESC, start) AS r, count(*) OVER (PARTITION BY seq_id) AS windows FROM win)
SELECT seq_id, L, start, round(score, 6) AS score, windows FROM b WHERE r = 1"""
record_em_step = f"WITH {ES.replace(POS, RECORDS)}, {EU}, {NEXT} {_SHOW}"


def _em_fold(k: int) -> str:
    """Scores of fold ``k`` by the motif of the other folds' positives after one iteration on these."""
    folds = f"fo AS (SELECT *, (row_number() OVER (ORDER BY seq_id) - 1) % 4 AS fold FROM seqs), tr AS (SELECT * FROM fo WHERE fold <> {k} AND seq_id % 2 = 0), te AS (SELECT * FROM fo WHERE fold = {k})"
    chain = f"{ES}, {EU}, {NEXT}".replace("FROM seqs) WHERE substr(seq, i, 3)", "FROM tr) WHERE substr(seq, i, 3)").replace("AS dseq FROM seqs)", "AS dseq FROM tr)").replace(f"{SEQS}, ", f"{SEQS}, {folds}, ", 1)
    again = POS.replace("ds AS", "td AS").replace("AS dseq FROM seqs)", "AS dseq FROM te)").replace("ps AS", "tp AS").replace("FROM ds)", "FROM td)")
    win = f"{again}, nl AS (SELECT nv.kmer, nv.j, ln(nv.v + 1e-5) - ln(bg.v) AS s FROM nv JOIN bg ON bg.kmer = nv.kmer), tw AS (SELECT seq_id, i - 1 - j AS start, sum(s) AS score FROM tp JOIN nl ON nl.kmer = tp.w WHERE i - 1 - j >= 0 GROUP BY seq_id, i - 1 - j HAVING count(*) = 10)"
    return f"(WITH {chain}, {win} SELECT seq_id AS id, max(score) AS score, CAST(1 - seq_id % 2 AS INT) AS is_pos FROM tw GROUP BY seq_id)"


cv_em_scores = "SELECT id, round(score, 5) AS score, is_pos FROM (" + " UNION ALL ".join(_em_fold(k) for k in range(4)) + ")"


def uniform(*parts: str, digits: int = 1) -> str:
    """The digits of md5 of the parts, from place ``digits`` on, as a number in [0, 1)."""
    return f"CAST('0x' || substr(md5({" || ':' || ".join(parts)}), {digits}, 13) AS BIGINT) / {float(1 << 52)!r}"


def _bounds(contexts: str, name: str, key: str = "") -> str:
    """name(key, t): the three bounds of every context's bases, in order of the contexts: none, one base, two bases."""
    k, p = (f"{key}, ", f"PARTITION BY {key}, ctx") if key else ("", "PARTITION BY ctx")
    return f"""{name}u AS (SELECT {k} ctx, b, sum(v) OVER ({p} ORDER BY b) / sum(v) OVER ({p}) AS upto FROM ({contexts})),
{name} AS (SELECT {k} list(upto ORDER BY length(ctx), ctx, b) AS t FROM {name}u WHERE b <> 'T' {f'GROUP BY {key}' if key else ''})"""


def _drawn(us: str, bounds: str, place: str = "a.k") -> str:
    """The string drawn by a list of uniform numbers; a.k: the number of the context, a.n: of letters so far."""
    d = f"(CAST(x.u >= {bounds}[3 * {place} + 1] AS INT) + CAST(x.u >= {bounds}[3 * {place} + 2] AS INT) + CAST(x.u >= {bounds}[3 * {place} + 3] AS INT))"
    new = f"CASE WHEN a.k = 0 THEN 1 + {d} ELSE 5 + 4 * ((a.k - 1) % 4) + {d} END"
    return f"list_reduce(list_prepend({{'u': 0.0::DOUBLE, 'k': 0, 'n': 0, 's': ''}}, list_transform({us}, lambda u: {{'u': u, 'k': 0, 'n': 0, 's': ''}})), lambda a, x: {{'u': 0.0::DOUBLE, 'k': {new}, 'n': a.n + 1, 's': a.s || substr('ACGT', 1 + {d}, 1)}}).s"


def _us(key: str, n: str) -> str:
    """A list of n uniform numbers, two a digest."""
    return f"list_transform(range(0, {n}), lambda p: CAST('0x' || substr(md5({key} || ':' || (p // 2)), 1 + 16 * (p % 2), 13) AS BIGINT) / {float(1 << 52)!r})"


_CONTEXTS = "SELECT left(kmer, k) AS ctx, right(kmer, 1) AS b, v FROM bg"
bg_sample = f"WITH {BG}, {_bounds(_CONTEXTS, 'bb')} SELECT seq_id, 0 AS copy, {_drawn(_us("'42:' || seq_id || ':0'", 'length(seq)'), 't')} AS seq FROM seqs, bb"
bg_sample_number = f"WITH {BG}, {_bounds(_CONTEXTS, 'bb')} SELECT seq_id, {_drawn(_us("'42:' || seq_id || ':0'", '200'), 't')} AS seq FROM (SELECT unnest(range(0, 500)) AS seq_id), bb"
bg_sample_rescaled = f"""WITH {BG}, so AS (SELECT seq_id, k, right(w, k + 1) AS kmer, count(*) AS n FROM (SELECT seq_id, w, unnest(range(0, length(w))) AS k FROM (SELECT seq_id, substr(seq, greatest(1, i - 2), least(i, 3)) AS w FROM (SELECT seq_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM seqs))) GROUP BY ALL),
sf AS (SELECT seqs.seq_id, bg.k, bg.kmer, bg.v, coalesce(so.n, 0) AS n FROM seqs CROSS JOIN bg LEFT JOIN so ON so.seq_id = seqs.seq_id AND so.k = bg.k AND so.kmer = bg.kmer),
sv AS (SELECT seq_id, left(kmer, k) AS ctx, right(kmer, 1) AS b, (n + 20 * v) / (sum(n) OVER (PARTITION BY seq_id, k, left(kmer, k)) + 20) AS v FROM sf),
{_bounds('SELECT * FROM sv', 'bb', 'seq_id')} SELECT seq_id, 0 AS copy, {_drawn(_us("'42:' || seq_id || ':0'", 'length(seq)'), 't')} AS seq FROM seqs JOIN bb USING (seq_id)"""
embed = f"""WITH {MV}, {_bounds("SELECT j, left(kmer, k) AS ctx, right(kmer, 1) AS b, v FROM mv WHERE k = least(j, 2)", 'jb', 'j')},
mb AS (SELECT flatten(list(CASE WHEN j = 0 THEN t WHEN j = 1 THEN list_concat([0, 0, 0], t) ELSE list_concat(list_transform(range(0, 15), lambda i: 0), t) END ORDER BY j)) AS t FROM jb),
ch AS (SELECT seq_id, seq, CASE WHEN {uniform("'42'", "seq_id", "'chosen'")} < 0.3 THEN CAST(floor({uniform("'42'", "seq_id", "'start'")} * (length(seq) - 9)) + 1 AS INT) END AS start, {_us("'42:' || seq_id || ':site'", '10')} AS us FROM seqs),
pl AS (SELECT seq_id, seq, start, {_drawn('us', 't', "(CASE a.n WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 6 + 21 * (a.n - 2) END + a.k)")} AS site FROM ch, mb)
SELECT seq_id, start, CASE WHEN start IS NULL THEN seq ELSE left(left(seq, start - 1) || site || substr(seq, start), length(seq)) END AS seq FROM pl"""
delete_sites = f"""WITH {SEQS}, p AS (SELECT seq_id, i, substr(seq, i, 1) AS c FROM (SELECT seq_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM seqs)),
h AS (SELECT DISTINCT seq_id, unnest(range(i, i + 10)) AS i FROM (SELECT seq_id, seq, unnest(range(1, length(seq) - 8)) AS i FROM seqs) WHERE substr(seq, i, 3) = 'CAT')
SELECT seq_id, rpad(coalesce(string_agg(translate(c, 'G', 'N'), '' ORDER BY p.i) FILTER (h.i IS NULL), ''), CAST(count(*) AS INT), 'N') AS seq FROM p LEFT JOIN h USING (seq_id, i) GROUP BY seq_id"""
em_positions = f"WITH {ES} SELECT seq_id, CASE WHEN start < L THEN '+' ELSE '-' END AS strand, start + 1 AS first_base, start + 10 AS last_base, substr(dseq, start + 1, 10) AS pattern FROM rs JOIN ds USING (seq_id) WHERE r >= 0.3"
position_density = f"""WITH {FIRST}, pl AS (SELECT CASE WHEN start < L THEN '+' ELSE '-' END AS strand, CAST(floor(CASE WHEN start < L THEN start ELSE start - L - 1 END + 5) - floor(L / 2) AS DOUBLE) AS c FROM fb),
sb AS (SELECT strand, count(*) AS total, coalesce(0.9 * CASE WHEN least(stddev_samp(c), (quantile_cont(c, 0.75) - quantile_cont(c, 0.25)) / 1.34) > 0 THEN least(stddev_samp(c), (quantile_cont(c, 0.75) - quantile_cont(c, 0.25)) / 1.34) WHEN stddev_samp(c) > 0 THEN stddev_samp(c) END * power(count(*), -0.2), 1) AS h FROM pl GROUP BY strand),
gr AS (SELECT strand, h, total, unnest(range(0, 101)) AS i, (SELECT (floor(max(abs(c)) / 10) + 1) * 10 FROM pl) AS reach FROM sb)
SELECT g.strand, round(i * 2 * reach / 100 - reach, 6) AS x, round(coalesce(sum(exp(-power((i * 2 * reach / 100 - reach - c) / h, 2) / 2) / (total * h * 2.5066282746310002)) FILTER (abs(i * 2 * reach / 100 - reach - c) <= 5 * h), 0), 8) AS density
FROM gr g JOIN pl sc ON sc.strand = g.strand GROUP BY g.strand, i, reach"""


def _round(k: int) -> str:
    """Iteration ``k``: from the conditionals nv of the one before (mv at first) to nv{k}."""
    text = f"{ES.removeprefix(f'{MV}, {POS}, ')}, {EU}, {NEXT}"
    for name in ("lr", "wo", "nm", "rs", "e", "u", "nf", "n0", "n1", "n2", "nv"):
        text = re.sub(rf"\b{name}\b(?!\()", f"{name}{k}_", text)
    return re.sub(r"\bmv\b", f"nv{k - 1}_" if k > 1 else "mv", text)


em_rounds = f"WITH {MV}, {POS}, {_round(1)}, {_round(2)}, {_round(3)} SELECT CAST(k AS INT) AS k, CAST(j AS INT) AS j, kmer, round(v, 5) AS v FROM nv3_"
sampled_start = f"""WITH {MV}, {POS}, lr AS (SELECT bg.kmer, m0.j, ln(greatest(m0.v, 1e-8)) - ln(bg.v) AS s FROM bg JOIN m0 ON m0.kmer = right(bg.kmer, 1)),
wo AS (SELECT seq_id, i - 1 - j AS start, exp(sum(s)) AS odds FROM ps JOIN lr ON lr.kmer = ps.w WHERE i - 1 - j >= 0 GROUP BY seq_id, i - 1 - j HAVING count(*) = 10),
nm AS (SELECT seq_id, count(*) AS n, 0.7 + 0.3 / count(*) * sum(odds) AS norm FROM wo GROUP BY seq_id),
cu AS (SELECT seq_id, start, sum(0.3 / n * odds / norm) OVER (PARTITION BY seq_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS upto FROM wo JOIN nm USING (seq_id)),
rs AS (SELECT seq_id, min(start) AS start, 1.0 AS r FROM cu WHERE upto > {uniform("'42'", "seq_id", "'site'")} GROUP BY seq_id), {EU}, {NEXT} {_SHOW}"""
