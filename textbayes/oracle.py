"""DuckDB twins of the queries: one chain of common table expressions, of which each query takes what it needs."""

from __future__ import annotations

# The marks, placeholders and patterns of normalization, in the order in which they are applied.
MARKS = "，。！？；："
BEFORE_MARKS = (("<[^>]*>", ""), (r"https?://[^\s]+|www\.[^\s]+", "网址"), (r"[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}", "邮箱"), (r"\d+(?:[.,]\d+)*", "数字"))
AFTER_MARKS = ((r"\s+", ""), (r"[^a-z0-9\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}，。！？；：、]+", "，"), ("，+", "，"))


def _model_text(text: str) -> str:
    x = f"lower(coalesce({text}, ''))"
    for pattern, to in BEFORE_MARKS:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    x = f"translate({x}, ',.!?;:', '{MARKS}')"
    for m in MARKS:
        x = f"regexp_replace({x}, '{m}+', '{m}', 'g')"
    for pattern, to in AFTER_MARKS:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return f"trim({x}, '，。；：、')"


def _bigrams(text: str) -> str:
    return f"list_concat(regexp_extract_all({text}, '(?s)..'), regexp_extract_all(substr({text}, 2), '(?s)..'))"


def _trigrams(text: str) -> str:
    return f"list_concat(list_concat(regexp_extract_all({text}, '(?s)...'), regexp_extract_all(substr({text}, 2), '(?s)...')), regexp_extract_all(substr({text}, 3), '(?s)...'))"


def _mi(a: str, b: str) -> str:
    def cell(joint, feature, label):
        return f"(CASE WHEN {joint} > 0 THEN {joint} / n::DOUBLE * ln({joint} / n::DOUBLE / ({feature} / n::DOUBLE * ({label} / n::DOUBLE))) ELSE 0 END)"

    gone = f"(n0 + n1 - {a} - {b})"
    return f"greatest({cell(a, f'({a} + {b})', 'n0')} + {cell(b, f'({a} + {b})', 'n1')} + {cell(f'(n0 - {a})', gone, 'n0')} + {cell(f'(n1 - {b})', gone, 'n1')}, 0)"


def _logit(df: str, n: str) -> str:
    p = f"(({df} + 0.5) / ({n} + 1.0))"
    return f"ln({p} / (1 - {p}))"


def _clip(df: str, n: str, l: str, r: str) -> str:
    rate = lambda x: f"(({x} + 0.5) / ({n} + 1.0))"
    return f"least(greatest(ln({rate(df)} / ({rate(l)} * {rate(r)})), -4.0), 4.0)"


# The frozen settings.
FROZEN = [
    ("random_seed", "42"), ("ngram_range", "[2, 2]"), ("min_df", "2"), ("max_features", "50000"), ("alpha", "0.05"), ("minimum_weight", "0.25"), ("maximum_boost", "0.5"), ("gamma", "1.0"), (
        "candidate_feature_count", "2000"
    ),
    (
        "maximum_features_per_document", "80"
    ), ("redundancy_minimum_pair_df", "20"), ("minimum_jaccard", "0.03"), ("top_k", "3"), ("redundancy_support_tau", "30.0"), ("redundancy_strength", "1.0"), ("redundancy_gamma", "0.5"),
    ("direction_smoothing", "0.5"), (
        "dependency_minimum_pair_df", "8"
    ), ("dependency_support_tau", "30.0"), ("dependency_smoothing", "0.5"), ("delta_clip", "4.0"), ("dependency_pair_count", "1000"), ("dependency_strength", "1.0"),
    ("maximum_pairs_per_document", "30"), ("train_dev_merge", "true"), ("bootstrap_resamples", "5000"), ("bootstrap_seed_offset", "100"),
]

MODELS = ["StandardNB", "FWNB", "DFWNB-v2", "SDFWNB"]

#: name: (what it reads, SQL). Everything is materialized, so that no part runs twice.
CHAIN: dict[str, tuple[list[str], str]] = {
    "norm": ([], f"SELECT doc_id, {_model_text('text')} AS m FROM documents"),
    "lab": (["norm"], "SELECT n.doc_id, l.quality AS label, n.m FROM norm n JOIN labels l USING (doc_id)"),
    "train": (["lab"], "SELECT * FROM lab"),
    "test": (["norm"], "SELECT n.doc_id, l.quality AS label, n.m FROM norm n LEFT JOIN labels l USING (doc_id)"),
    "grams": (
        ["train"],
        f"SELECT doc_id, label, gram, count(*) AS tf FROM (SELECT doc_id, label, unnest({_bigrams('m')}) AS gram FROM train) WHERE NOT "
        f"regexp_full_match(gram, '[，。！？；：、]+') GROUP BY ALL"
    ),
    "test_grams": (
        ["test"],
        f"SELECT doc_id, label, gram, count(*) AS tf FROM (SELECT doc_id, label, unnest({_bigrams('m')}) AS gram FROM test) WHERE NOT "
        f"regexp_full_match(gram, '[，。！？；：、]+') GROUP BY ALL"
    ),
    "terms": (
        ["grams"],
        "SELECT gram, count(*) AS df, sum(tf)::BIGINT AS tf, count(*) FILTER (label <> 1) AS df0, count(*) FILTER (label = 1) AS df1, "
        "sum(CASE WHEN label <> 1 THEN tf ELSE 0 END)::BIGINT AS tf0, sum(CASE WHEN label = 1 THEN tf ELSE 0 END)::BIGINT AS tf1 FROM grams "
        "GROUP BY gram HAVING count(*) >= 2"
    ),
    "vocab": (["terms"], "SELECT *, (row_number() OVER (ORDER BY df DESC, tf DESC, gram) - 1)::INT AS idx FROM terms QUALIFY idx < 50000"),
    "totals": (["train"], "SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1, count(*) AS n FROM train"),
    "info": (
        ["vocab", "totals"],
        f"SELECT v.*, n0, n1, n, round({_mi('df0', 'df1')}, 12) AS mi, {_logit('df1', 'n1')} - {_logit('df0', 'n0')} AS direction FROM vocab v, totals"
    ),
    "stats": (
        ["info"],
        "SELECT *, CASE WHEN max(mi) OVER () > 0 THEN mi / max(mi) OVER () ELSE 0 END AS norm_mi, 0.25 + 1.25 * CASE WHEN max(mi) OVER () > 0 "
        "THEN mi / max(mi) OVER () ELSE 0 END AS w_fwnb FROM info"
    ),
    "cands": (["stats"], "SELECT idx, mi FROM stats WHERE regexp_full_match(gram, '[a-z]{2}') ORDER BY mi DESC, idx LIMIT 2000"),
    "best": (
        ["grams", "vocab", "cands"],
        "SELECT g.doc_id, v.idx FROM grams g JOIN vocab v USING (gram) JOIN cands c USING (idx) QUALIFY row_number() OVER (PARTITION BY "
        "g.doc_id ORDER BY c.mi DESC, v.idx) <= 80"
    ),
    "cooc": (
        ["best"],
        'SELECT a.idx AS "left", b.idx AS "right", count(*) AS n FROM best a JOIN best b ON a.doc_id = b.doc_id AND a.idx < b.idx GROUP BY ALL'
    ),
    "rel": (
        ["cooc", "stats"],
        """SELECT "left", "right", n, n / u AS jaccard, round(n / u * least(abs(dl), abs(dr)) / (greatest(abs(dl), abs(dr)) + 1e-12) * n / (n + 30.0), 12) AS score,
        CASE WHEN ml < mr OR (ml = mr AND fl < fr) THEN "left" ELSE "right" END AS penalized
        FROM (SELECT c."left", c."right", c.n, (l.df + r.df - c.n)::DOUBLE AS u, l.direction AS dl, r.direction AS dr, l.mi AS ml, r.mi AS mr, l.df AS fl, r.df AS fr, l.gram AS gl, r.gram AS gr
              FROM cooc c JOIN stats l ON l.idx = c."left" JOIN stats r ON r.idx = c."right" WHERE c.n >= 20)
        WHERE len(list_intersect(string_split(gl, ''), string_split(gr, ''))) = 0 AND dl * dr > 0 AND u > 0 AND 100 * n >= 3 * u""",
    ),
    "raw": (
        ["rel"],
        'SELECT penalized AS idx, avg(score) AS raw FROM (SELECT * FROM rel QUALIFY row_number() OVER (PARTITION BY penalized ORDER BY score '
        'DESC, "left", "right") <= 3) GROUP BY 1'
    ),
    "red": (
        ["raw"],
        "SELECT idx, least(greatest(raw / (SELECT coalesce(nullif(quantile_cont(raw, 0.95), 0), 1) FROM raw WHERE raw > 0), 0), 1) AS redundancy FROM raw"
    ),
    "shrunk": (
        ["stats", "red"],
        "SELECT s.*, coalesce(redundancy, 0) AS redundancy, w_fwnb / (1 + sqrt(coalesce(redundancy, 0))) AS s FROM stats s LEFT JOIN red USING (idx)"
    ),
    "weights": (["shrunk"], "SELECT *, s * avg(w_fwnb) OVER () / avg(s) OVER () AS w_dfwnb FROM shrunk"),
    "params": (
        ["weights"],
        "SELECT *, ln((tf0 + 0.05) / (sum(tf0) OVER () + 0.05 * count(*) OVER ())) AS logp0, ln((tf1 + 0.05) / (sum(tf1) OVER () + 0.05 * "
        "count(*) OVER ())) AS logp1, ln(n0 / n::DOUBLE) AS log_prior_0, ln(n1 / n::DOUBLE) AS log_prior_1 FROM weights"
    ),
    "script": (["vocab"], "SELECT gram, idx FROM vocab WHERE regexp_full_match(gram, '[a-z]{2}')"),
    "pairs": (
        ["train", "script"],
        f"SELECT DISTINCT t.doc_id, t.label, l.idx AS left_idx, r.idx AS right_idx FROM (SELECT doc_id, label, unnest({_trigrams('m')}) AS g "
        f"FROM train) t JOIN script l ON l.gram = substr(g, 1, 2) JOIN script r ON r.gram = substr(g, 2, 2) WHERE l.idx <> r.idx"
    ),
    "test_pairs": (
        ["test", "script"],
        f"SELECT DISTINCT t.doc_id, t.label, l.idx AS left_idx, r.idx AS right_idx FROM (SELECT doc_id, label, unnest({_trigrams('m')}) AS g "
        f"FROM test) t JOIN script l ON l.gram = substr(g, 1, 2) JOIN script r ON r.gram = substr(g, 2, 2) WHERE l.idx <> r.idx"
    ),
    "freq": (
        ["pairs"],
        "SELECT left_idx, right_idx, count(*) FILTER (label <> 1) AS f0, count(*) FILTER (label = 1) AS f1, count(*) AS total FROM pairs "
        "GROUP BY ALL HAVING count(*) >= 8"
    ),
    "deltas": (
        ["freq", "info"],
        f"SELECT f.*, l.gram AS lg, r.gram AS rg, l.n0, l.n1, l.n, total / (total + 30.0) AS support, {_clip('f0', 'l.n0', 'l.df0', 'r.df0')} "
        f"AS raw0, {_clip('f1', 'l.n1', 'l.df1', 'r.df1')} AS raw1 FROM freq f JOIN info l ON l.idx = left_idx JOIN info r ON r.idx = "
        f"right_idx"
    ),
    "dep": (
        ["deltas"],
        f"""SELECT *, round(abs(d1 - d0), 12) AS contrast, round({_mi('f0', 'f1')}, 12) AS pmi
        FROM (SELECT *, raw0 * support - (raw0 + raw1) * support / 2 AS d0, raw1 * support - (raw0 + raw1) * support / 2 AS d1 FROM deltas)""",
    ),
    "corr": (["dep"], "SELECT left_idx, right_idx, d0, d1, contrast FROM dep ORDER BY contrast DESC, pmi DESC, total DESC, left_idx, right_idx LIMIT 1000"),
    "active": (
        ["test_pairs", "corr"],
        "SELECT p.doc_id, p.left_idx, p.right_idx, c.d0, c.d1 FROM test_pairs p JOIN corr c USING (left_idx, right_idx) QUALIFY row_number() "
        "OVER (PARTITION BY p.doc_id ORDER BY c.contrast DESC, left_idx, right_idx) <= 30"
    ),
    "known": (["test_grams", "params"], "SELECT g.doc_id, g.tf, p.* EXCLUDE (tf) FROM test_grams g JOIN params p USING (gram)"),
    "scored": (
        ["test", "known", "active", "params"],
        """SELECT t.doc_id, t.label, p0 + coalesce(a0, 0) AS standardnb_0, p1 + coalesce(a1, 0) AS standardnb_1, p0 + coalesce(b0, 0) AS fwnb_0, p1 + coalesce(b1, 0) AS fwnb_1,
        p0 + coalesce(c0, 0) AS dfwnb_v2_0, p1 + coalesce(c1, 0) AS dfwnb_v2_1, p0 + coalesce(c0, 0) + coalesce(e0, 0) AS sdfwnb_0, p1 + coalesce(c1, 0) + coalesce(e1, 0) AS sdfwnb_1
        FROM test t CROSS JOIN (SELECT any_value(log_prior_0) AS p0, any_value(log_prior_1) AS p1 FROM params)
        LEFT JOIN (SELECT doc_id, sum(tf * logp0) AS a0, sum(tf * logp1) AS a1, sum(tf * w_fwnb * logp0) AS b0, sum(tf * w_fwnb * logp1) AS b1, sum(tf * w_dfwnb * logp0) AS c0, sum(tf * w_dfwnb * logp1) AS c1 FROM known GROUP BY 1) k ON k.doc_id = t.doc_id
        LEFT JOIN (SELECT doc_id, sum(d0) AS e0, sum(d1) AS e1 FROM active GROUP BY 1) e ON e.doc_id = t.doc_id""",
    ),
    "pred": (
        ["scored"],
        "SELECT model, doc_id, label, s0, s1, 1 / (1 + exp(s0 - s1)) AS p1, CASE WHEN s1 > s0 THEN 1 ELSE 0 END AS pred FROM ("
        + " UNION ALL ".join(
            f"SELECT '{m}' AS model, doc_id, label, {c}_0 AS s0, {c}_1 AS s1 FROM scored" for m,
            c in ((m, m.lower().replace("-", "_")) for m in MODELS)
        )
        + ")",
    ),
    "judged": (["pred"], "SELECT * FROM pred WHERE label IS NOT NULL"),
    "evidence": (["known"], """SELECT doc_id, idx, gram, tf, e0, e1, row_number() OVER (PARTITION BY doc_id ORDER BY round(abs(e1 - e0), 12) DESC, idx) AS rk
        FROM (SELECT *, tf * w_dfwnb * logp0 AS e0, tf * w_dfwnb * logp1 AS e1 FROM known)"""),
    "effects": (["active", "vocab"], """SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(abs(d1 - d0), 12) DESC, trigram) AS rk
        FROM (SELECT a.*, l.gram || substr(r.gram, 2, 1) AS trigram FROM active a JOIN vocab l ON l.idx = left_idx JOIN vocab r ON r.idx = right_idx)"""),
    "conf": (
        ["judged"],
        "SELECT model, count(*) FILTER (label <> 1 AND pred <> 1) AS tn, count(*) FILTER (label <> 1 AND pred = 1) AS fp, count(*) FILTER "
        "(label = 1 AND pred <> 1) AS fn, count(*) FILTER (label = 1 AND pred = 1) AS tp FROM judged GROUP BY 1"
    ),
    "ranks": (
        ["judged"],
        "SELECT model, label, rank() OVER (PARTITION BY model ORDER BY p1) + (count(*) OVER (PARTITION BY model, p1) - 1) / 2.0 AS r FROM judged"
    ),
    "auc": (
        ["ranks"],
        "SELECT model, CASE WHEN count(*) FILTER (label = 1) > 0 AND count(*) FILTER (label <> 1) > 0 THEN (sum(r) FILTER (label = 1) - "
        "count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1)::DOUBLE * count(*) FILTER "
        "(label <> 1)) END AS auc FROM ranks GROUP BY 1"
    ),
    "keys": (
        [],
        r"SELECT doc_id AS row_id, (doc_id % 2) AS label, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 = 7 THEN 'dev' ELSE 'test' "
        r"END AS split, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS k, text FROM documents"
    ),
    "c1": (
        ["keys"],
        "SELECT *, CASE WHEN min(label) OVER w < max(label) OVER w THEN 'conflict' WHEN row_id > min(row_id) OVER w THEN 'duplicate' END AS r "
        "FROM keys WINDOW w AS (PARTITION BY split, k)"
    ),
    "c2": (
        ["c1"],
        "SELECT * EXCLUDE (r), coalesce(r, CASE WHEN split <> 'test' AND bool_or(split = 'test' AND r IS NULL) OVER w THEN 'in_test' WHEN "
        "split = 'train' AND bool_or(split = 'dev' AND r IS NULL) OVER w THEN 'in_dev' END) AS raw_reason FROM c1 WINDOW w AS (PARTITION BY "
        "k)"
    ),
    "c3": (["c2"], f"SELECT *, {_model_text('text')} AS m FROM c2 WHERE raw_reason IS NULL"),
    "c4": (
        ["c3"],
        "SELECT *, CASE WHEN m = '' THEN 'empty' WHEN min(label) OVER w < max(label) OVER w THEN 'conflict' WHEN row_id > min(row_id) OVER w "
        "THEN 'duplicate' END AS r FROM c3 WINDOW w AS (PARTITION BY split, m)"
    ),
    "c5": (
        ["c4"],
        "SELECT split, row_id, label, m, raw_reason, coalesce(r, CASE WHEN split <> 'test' AND bool_or(split = 'test' AND r IS NULL) OVER w "
        "THEN 'in_test' WHEN split = 'train' AND bool_or(split = 'dev' AND r IS NULL) OVER w THEN 'in_dev' END) AS model_reason FROM c4 "
        "WINDOW w AS (PARTITION BY m)"
    ),
    "cleaned": (
        ["c2", "c5"],
        "SELECT split, row_id, label, m, raw_reason, model_reason FROM c5 UNION ALL SELECT split, row_id, label, NULL, raw_reason, NULL FROM "
        "c2 WHERE raw_reason IS NOT NULL"
    ),
}


#: What the final test has otherwise: labelled documents in splits, cleaned; train and dev to fit, test to judge.
FINAL = {
    "keys": (
        [],
        CHAIN["keys"][1].replace("(doc_id % 2) AS label", "l.quality AS label").replace("FROM documents", "FROM documents JOIN labels l USING (doc_id)")
    ),
    "train": (["cleaned"], "SELECT row_id AS doc_id, label, m FROM cleaned WHERE split <> 'test' AND raw_reason IS NULL AND model_reason IS NULL"),
    "test": (["cleaned"], "SELECT row_id AS doc_id, label, m FROM cleaned WHERE split = 'test' AND raw_reason IS NULL AND model_reason IS NULL"),
}


def _with(select: str, *names: str, final: bool = False) -> str:
    chain, need = CHAIN | FINAL if final else CHAIN, []

    def add(name):
        for n in chain[name][0]:
            add(n)
        if name not in need:
            need.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({chain[n][1]})" for n in need) + "\n" + select


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c.split('.')[-1]}" if " AS " not in c else "round({}, 6) AS {}".format(*c.split(" AS ")) for c in columns)


def _ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"


def _metrics() -> str:
    return f"""SELECT model, tn, fp, fn, tp, {_r('accuracy', 'precision_negative', 'recall_negative', 'precision_positive', 'recall_positive', 'f1_negative', 'f1_positive')},
    {_r('(precision_negative + precision_positive) / 2 AS macro_precision', '(recall_negative + recall_positive) / 2 AS macro_recall', '(f1_negative + f1_positive) / 2 AS macro_f1', '(recall_negative + recall_positive) / 2 AS balanced_accuracy', 'recall_negative AS specificity', 'auc')}
    FROM (SELECT *, {_ratio('2 * precision_negative * recall_negative', 'precision_negative + recall_negative')} AS f1_negative, {_ratio('2 * precision_positive * recall_positive', 'precision_positive + recall_positive')} AS f1_positive
          FROM (SELECT *, {_ratio('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {_ratio('tn', 'tn + fn')} AS precision_negative, {_ratio('tn', 'tn + fp')} AS recall_negative, {_ratio('tp', 'tp + fp')} AS precision_positive, {_ratio('tp', 'tp + fn')} AS recall_positive FROM conf))
    JOIN auc USING (model)"""


def _top(where: str) -> str:
    return f"SELECT idx, gram AS feature, {_r('mi AS mutual_information', 'direction')}, CASE WHEN direction > 0 THEN 'positive' ELSE 'negative' END AS preferred_class, {_r('w_fwnb')}, df FROM stats WHERE {where} ORDER BY stats.mi DESC, idx LIMIT 20"


_MCNEMAR_PAIRS = "(VALUES ('StandardNB', 'SDFWNB'), ('FWNB', 'DFWNB-v2'), ('DFWNB-v2', 'SDFWNB')) v(model_a, model_b)"
_BOOTSTRAP_PAIRS = "(VALUES ('StandardNB', 'FWNB'), ('FWNB', 'DFWNB-v2'), ('DFWNB-v2', 'SDFWNB'), ('StandardNB', 'SDFWNB')) v(model_a, model_b)"
_MCNEMAR = f"""SELECT model_a, model_b, b AS a_correct_b_wrong, c AS a_wrong_b_correct, b + c AS discordant_pairs, round(p, 6) AS p_value_exact_two_sided, p < 0.05 AS significant
    FROM (SELECT *, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1),
            lambda k: exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2))))) END AS p
          FROM (SELECT model_a, model_b, count(*) FILTER (x.pred = x.label AND y.pred <> y.label) AS b, count(*) FILTER (x.pred <> x.label AND y.pred = y.label) AS c
                FROM {_MCNEMAR_PAIRS} JOIN judged x ON x.model = model_a JOIN judged y ON y.model = model_b AND y.doc_id = x.doc_id GROUP BY ALL))"""
_PREDICTIONS = f"SELECT model, doc_id, label, {_r('s0 AS score0', 's1 AS score1', 'p1')}, pred FROM pred"
_EXPLAINED = f"""SELECT p.doc_id, p.pred, {_r('p.s0 AS score0', 'p.s1 AS score1', 'coalesce(v.a0, 0) AS evidence_0', 'coalesce(v.a1, 0) AS evidence_1', 'coalesce(x.b0, 0) AS effect_0', 'coalesce(x.b1, 0) AS effect_1', 'q.p0 AS log_prior_0', 'q.p1 AS log_prior_1')},
    coalesce(v.names, '') AS features, coalesce(x.names, '') AS dependencies, CAST(coalesce(v.n, 0) AS INT) AS n_features, CAST(coalesce(x.n, 0) AS INT) AS n_dependencies
    FROM (SELECT * FROM pred WHERE model = 'SDFWNB') p CROSS JOIN (SELECT any_value(log_prior_0) AS p0, any_value(log_prior_1) AS p1 FROM params) q
    LEFT JOIN (SELECT doc_id, sum(e0) AS a0, sum(e1) AS a1, string_agg(gram, ' ' ORDER BY rk) FILTER (rk <= 10) AS names, least(count(*), 10) AS n FROM evidence GROUP BY 1) v ON v.doc_id = p.doc_id
    LEFT JOIN (SELECT doc_id, sum(d0) AS b0, sum(d1) AS b1, string_agg(trigram, ' ' ORDER BY rk) FILTER (rk <= 10) AS names, least(count(*), 10) AS n FROM effects GROUP BY 1) x ON x.doc_id = p.doc_id"""
#: What ends a line, and becomes one space in tab-separated files.
_LINE_ENDS = r"[\t\n\r\x0b\x0c\x1c-\x1f\x{85}\x{2028}\x{2029}]+"


def _one_line(text: str) -> str:
    return f"trim(regexp_replace(coalesce({text}, ''), '{_LINE_ENDS}', ' ', 'g'), ' ')"


def oracle_sql() -> dict[str, str]:
    reasons = ", ".join(f"count(*) FILTER ({test}) AS {name}" for name, test in (
        ("raw_conflict", "raw_reason = 'conflict'"), (
            "raw_duplicate", "raw_reason = 'duplicate'"
        ), ("raw_leak", "raw_reason LIKE 'in_%'"), ("raw_left", "raw_reason IS NULL"), ("model_empty", "model_reason = 'empty'"),
        ("model_conflict", "model_reason = 'conflict'"), ("model_duplicate", "model_reason = 'duplicate'"), ("model_leak", "model_reason LIKE 'in_%'"), ("model_left", "raw_reason IS NULL AND model_reason IS NULL")))
    return {
        "normalize_text": _with("SELECT doc_id, m AS model_text FROM norm", "norm"),
        "dup_key": r"SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS dup_key FROM documents",
        # NFKC makes of full-width texts what they were
        "normalize_wide": _with("SELECT doc_id, m AS model_text FROM norm", "norm"),
        "dup_key_wide": r"SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS dup_key FROM documents",
        "char_ngrams": _with(
                f"SELECT doc_id, gram, count(*) AS tf FROM (SELECT doc_id, unnest({_bigrams('m')}) AS gram FROM norm) WHERE NOT "
                f"regexp_full_match(gram, '[，。！？；：、]+') GROUP BY ALL",
            "norm"
        ),
        "unigram_bigram": _with(
                f"SELECT gram, count(*) AS n FROM (SELECT unnest(list_concat(regexp_extract_all(m, '(?s).'), {_bigrams('m')})) AS gram FROM norm) "
                f"WHERE NOT regexp_full_match(gram, '[，。！？；：、]+') GROUP BY ALL",
            "norm"
        ),
        "gram_predicates": _with(
                r"SELECT gram, regexp_full_match(gram, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]{2}') AS is_han, regexp_full_match(gram, '[a-z]{2}') "
                r"AS is_latin, regexp_matches(gram, '[the数]') AS shares, regexp_matches(gram, '数字|网址|邮箱') AS placeholder FROM vocab",
            "vocab"
        ),
        "vocab_df_tf": _with("SELECT idx, gram, df, tf FROM vocab", "vocab"),
        "vocab_topk": _with("SELECT idx, gram, df, tf FROM vocab WHERE idx < 100", "vocab"),
        "doc_term_counts": _with("SELECT doc_id, idx, g.tf FROM grams g JOIN vocab v USING (gram)", "grams", "vocab"),
        "clean_pipeline": _with("SELECT split, row_id, raw_reason, model_reason FROM cleaned", "cleaned"),
        "clean_ready": _with("SELECT split, row_id, label, m AS model_text FROM cleaned WHERE raw_reason IS NULL AND model_reason IS NULL", "cleaned"),
        "clean_summary": _with(f"SELECT split, count(*) AS n_rows, {reasons} FROM cleaned GROUP BY split", "cleaned"),
        "class_df": _with("SELECT idx, df0, df1, tf0, tf1, n0, n1 FROM info", "info"),
        "feature_information": _with(f"SELECT idx, gram, {_r('mi', 'norm_mi', 'direction', 'w_fwnb')} FROM stats", "stats"),
        "redundancy_candidates": _with(f"SELECT idx, {_r('mi')} FROM cands", "cands"),
        "pair_cooccurrence": _with('SELECT "left", "right", n FROM cooc', "cooc"),
        "redundancy_relations": _with(f'SELECT "left", "right", n, {_r("jaccard", "score")}, penalized FROM rel', "rel"),
        "dfwnb_weights": _with(f"SELECT idx, {_r('redundancy', 'w_fwnb', 'w_dfwnb')} FROM weights", "weights"),
        "doc_pairs": _with("SELECT doc_id, left_idx, right_idx FROM pairs", "pairs"),
        "dependency_table": _with(
            f"""SELECT left_idx AS left_index, right_idx AS right_index, lg AS left_feature, rg AS right_feature, lg || substr(rg, 2, 1) AS trigram, f0 AS neg_doc_freq, f1 AS pos_doc_freq, total AS total_doc_freq,
            {_r('support AS support_factor', 'raw0 AS delta_raw_0', 'raw1 AS delta_raw_1', 'd0 AS delta_0', 'd1 AS delta_1', 'contrast AS dependency_contrast', 'pmi AS pair_label_mi')}, CASE WHEN d1 > 0 THEN 'positive' ELSE 'negative' END AS preferred_class, {_r('contrast AS selection_score')} FROM dep""",
            "dep",
        ),
        "dependency_selection": _with(f"SELECT left_idx, right_idx, {_r('d0 AS delta_0', 'd1 AS delta_1', 'contrast AS relevance')} FROM corr", "corr"),
        "nb_params": _with(f"SELECT idx, {_r('logp0', 'logp1', 'log_prior_0', 'log_prior_1')} FROM params", "params"),
        "score_all": _with("SELECT doc_id, label, " + _r(*(f"{m.lower().replace('-', '_')}_{c}" for m in MODELS for c in (0, 1))) + " FROM scored", "scored"),
        "predict_all": _with(_PREDICTIONS, "pred"),
        "model_roundtrip": _with(_PREDICTIONS, "pred"),
        "metrics_all": _with(_metrics(), "conf", "auc"),
        "mcnemar_all": _with(_MCNEMAR, "judged"),
        "macro_f1_all": _with(f"SELECT model, macro_f1 FROM ({_metrics()})", "conf", "auc"),
        "bootstrap_cells": _with(
                f"SELECT model_a, model_b, x.label, x.pred AS pred_a, y.pred AS pred_b, count(*) AS n FROM {_BOOTSTRAP_PAIRS} JOIN judged x ON "
                f"x.model = model_a JOIN judged y ON y.model = model_b AND y.doc_id = x.doc_id GROUP BY ALL",
            "judged"
        ),
        "final_test_metrics": _with(_metrics(), "conf", "auc", final=True),
        "final_test_confusion": _with("SELECT * FROM conf", "conf", final=True),
        "final_test_mcnemar": _with(_MCNEMAR, "judged", final=True),
        "final_test_predictions": _with(_PREDICTIONS, "pred", final=True),
        "explain_documents": _with(_EXPLAINED, "pred", "evidence", "effects", "params"),
        "vocab_unlimited": _with("SELECT (row_number() OVER (ORDER BY df DESC, tf DESC, gram) - 1)::INT AS idx, gram, df, tf FROM terms", "terms"),
        "class_params": _with(
                f"SELECT {_r('any_value(log_prior_0) AS log_prior_0', 'any_value(log_prior_1) AS log_prior_1')}, sum(tf0)::BIGINT AS n_tokens_0, "
                f"sum(tf1)::BIGINT AS n_tokens_1, count(*) AS n_features, any_value(n0) AS n0, any_value(n1) AS n1, (SELECT count(*) FROM corr) AS "
                f"n_corrections FROM params",
            "params", "corr"
        ),
        "top_features_negative": _with(_top("direction < 0"), "stats"),
        "top_redundant": _with(
            f"SELECT idx, gram AS feature, {_r('redundancy', 'w_fwnb', 'w_dfwnb')}, df FROM weights ORDER BY round(weights.redundancy, 6) DESC, idx LIMIT 20",
            "weights"
        ),
        "tsv_split":
            f"SELECT 'train' AS split, quality::BIGINT AS label, t AS text FROM (SELECT l.quality, {_one_line('d.text')} AS t FROM documents d "
            f"JOIN labels l USING (doc_id)) WHERE t <> ''",
        "tsv_gb18030": _with("SELECT 'train' AS split, label::BIGINT AS label, m AS text FROM lab WHERE m <> ''", "lab"),
        "tsv_odd_labels":
            f"SELECT 'train' AS split, CASE length(text) % 4 WHEN 0 THEN 0 ELSE 1 END::BIGINT AS label, t AS text FROM (SELECT text, "
            f"{_one_line('text')} AS t FROM conversations) WHERE t <> '' AND length(text) % 4 < 2",
        "label_domain": "SELECT (length(text) % 4)::BIGINT AS label, count(*) AS n FROM conversations WHERE length(text) % 4 > 1 GROUP BY 1",
        "frozen_config": "SELECT name, value FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in FROZEN) + ") v(name, value)",
        "tsv_in_order":
            "SELECT 'dev' AS split, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, (o_orderkey % 2)::BIGINT AS label, o_orderkey::BIGINT "
            "AS o_orderkey FROM orders",
        "file_checksums": "SELECT n_nationkey::BIGINT AS n_nationkey, sha256(n_name || chr(10)) AS sha256 FROM nation",
        "result_sinks": _with("SELECT conf.*, (SELECT count(*) FROM conf) AS n_rows, 0.05::DOUBLE AS alpha FROM conf", "conf"),
        "top_features": _with(_top("true"), "stats"),
        "top_features_positive": _with(_top("direction > 0"), "stats"),
        "top_dependencies": _with(
                f"SELECT lg || substr(rg, 2, 1) AS trigram, lg AS left_feature, rg AS right_feature, f0 AS neg_doc_freq, f1 AS pos_doc_freq, "
                f"{_r('d0 AS delta_0', 'd1 AS delta_1', 'contrast AS dependency_contrast')}, CASE WHEN d1 > 0 THEN 'positive' ELSE 'negative' END "
                f"AS preferred_class FROM dep ORDER BY dep.contrast DESC, pmi DESC, total DESC, left_idx, right_idx LIMIT 20",
            "dep",
        ),
        "explain_features": _with(
            f"""SELECT doc_id, CAST(rk AS INT) AS rank, gram AS feature, tf AS "count", {_r('w_fwnb AS weight', 'e0 AS evidence_negative', 'e1 AS evidence_positive')}
            FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(abs(e1 - e0), 12) DESC, idx) AS rk FROM (SELECT *, tf * w_fwnb * logp0 AS e0, tf * w_fwnb * logp1 AS e1 FROM known)) WHERE rk <= 10""",
            "known",
        ),
        "explain_dependencies": _with(
                f"SELECT doc_id, l.gram || substr(r.gram, 2, 1) AS trigram, l.gram AS left_feature, r.gram AS right_feature, "
                f"{_r('a.d0 AS effect_negative', 'a.d1 AS effect_positive')} FROM active a JOIN vocab l ON l.idx = left_idx JOIN vocab r ON r.idx "
                f"= right_idx",
            "active", "vocab",
        ),
    }
