"""DuckDB SQL for the registered queries.

Common table expressions are named once below with the ones they build on; an oracle
lists the ones it needs and a final SELECT.
"""

from __future__ import annotations

import unicodedata

from rankloom.functions.text import ABBREVIATIONS, STOPWORDS
from rankloom.operators import latent
from rankloom.operators.alignment import NEGATIONS, NUMBER, SHORT_NEGATION
from rankloom.operators.encoders import FIT_RATE, FIT_RIDGE, FIT_STEPS, HASH_DIMS, OVERLAP_CLAMP, PRIOR_WEIGHTS
from rankloom.operators.resampling import POISSON_STEPS

SPACE = (r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WS = f"[{SPACE}]"
WORD = r"[\p{L}\p{N}_]"
CLOSERS = r"""["'')\]]*"""  # the quote is doubled for SQL
MARK = "chr(30)"
GUARD = "chr(1)"


def _composed() -> dict[str, tuple[str, str]]:
    """Latin letters that decompose into a base letter and one mark, by rule."""
    pairs = {}
    for code in range(0xC0, 0x180):
        decomposed = unicodedata.normalize("NFKD", chr(code))
        if len(decomposed) == 2 and unicodedata.combining(decomposed[1]):
            pairs[chr(code)] = (decomposed[0], decomposed[1])
    return pairs


def normalized(text: str) -> str:
    pairs = _composed()
    for mark in sorted({mark for _, mark in pairs.values()}):
        letters = "".join(c for c, (_, m) in pairs.items() if m == mark)
        text = rf"regexp_replace({text}, '([{letters}])', '\1' || chr({ord(mark)}), 'g')"
    return f"lower(translate({text}, '{''.join(pairs)}', '{''.join(base for base, _ in pairs.values())}'))"


def words_of(text: str) -> str:
    return f"regexp_extract_all({text}, '{WORD}+')"


def stripped(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def index_tokens(text: str) -> str:
    return f"list_filter({words_of(normalized(text))}, lambda t: NOT list_contains({_STOP}, t))"


def overlap_tokens(text: str) -> str:
    return words_of(f"lower({text})")


def jaccard(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {union} = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / {union} END"


def clamped(share: str) -> str:
    return f"greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, {share}))"


# name -> (needed names, sql)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], sql: str) -> str:
    CTES[name] = (needs, sql)
    return name


def with_ctes(needs: tuple[str, ...], select: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for need in CTES[name][0]:
                visit(need)
            ordered.append(name)

    for need in needs:
        visit(need)
    if not ordered:
        return select
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in ordered) + "\n" + select


cte("docs", (), "SELECT doc_id::VARCHAR AS doc_id, text, source FROM documents")
cte("questions", (), "SELECT item_id::VARCHAR AS qid, text AS question, text AS passage FROM benchmark")

# --- sentences ---
_LETTER_ABBREVIATIONS = "|".join(a for a in ABBREVIATIONS if "." not in a)
cte("a_pieces", ("docs",), f"""
    SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM (
      SELECT doc_id, string_split(
        regexp_replace(
          regexp_replace({stripped('text')}, '([.!?]){CLOSERS}{WS}*$', '\\1'),
          '([.!?]){CLOSERS}{WS}+([A-Z])', '\\1' || {MARK} || '\\2', 'g'), {MARK}) AS p
      FROM docs WHERE regexp_matches(text, '[^{SPACE}]'))""")
cte("a_groups", ("a_pieces",), f"""
    SELECT doc_id, i, piece, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
    FROM (SELECT *, coalesce(lag(regexp_matches(piece, '(^|[^\\p{{L}}\\p{{N}}_])(?i:{_LETTER_ABBREVIATIONS})\\.$'))
                 OVER (PARTITION BY doc_id ORDER BY i), false) AS joins FROM a_pieces)""")
cte("a_sentences", ("a_groups",), """
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS pos, sentence
    FROM (SELECT doc_id, g, string_agg(piece, ' ' ORDER BY i) AS sentence FROM a_groups GROUP BY doc_id, g)
    WHERE sentence <> ''""")


def b_sentences(text: str) -> str:
    """List of answer sentences of a text expression."""
    guarded = (f"regexp_replace(regexp_replace({stripped(text)}, "
               f"'({WORD}\\.{WORD}[.?!])({WS})', '\\1' || {GUARD} || '\\2', 'g'), "
               f"'([A-Z][a-z]\\.)({WS})', '\\1' || {GUARD} || '\\2', 'g')")
    marked = f"regexp_replace({guarded}, '([.?!]){WS}+', '\\1' || {MARK}, 'g')"
    parts = f"string_split(replace({marked}, {GUARD}, ''), {MARK})"
    return (f"list_filter(list_transform({parts}, lambda s: {stripped('s')}), lambda s: s <> '')")


# --- chunks ---
def fixed_windows(name: str, size: int, step: int) -> str:
    return cte(name, ("docs",), f"""
    SELECT doc_id || '::fixed::' || (st // {step})::BIGINT AS chunk_id, doc_id, (st // {step})::BIGINT AS index,
           st::BIGINT AS word_start, least(st + {size}, len(w))::BIGINT - 1 AS word_end,
           array_to_string(w[st + 1 : st + {size}], ' ') AS text
    FROM (SELECT doc_id, w, unnest(range(0, len(w), {step})) AS st FROM (
      SELECT doc_id, string_split(trim(regexp_replace(text, '{WS}+', ' ', 'g'), ' '), ' ') AS w
      FROM docs WHERE regexp_matches(text, '[^{SPACE}]')))""")


fixed_windows("fixed", 200, 160)
fixed_windows("small_fixed", 20, 16)
cte("sentwin", ("a_sentences",), """
    SELECT doc_id || '::sentence_window::' || (st // 2)::BIGINT AS chunk_id, doc_id, (st // 2)::BIGINT AS index,
           st::BIGINT AS sent_start, least(st + 3, len(s))::BIGINT - 1 AS sent_end,
           (least(st + 3, len(s)) - st)::BIGINT AS num_sentences, array_to_string(s[st + 1 : st + 3], ' ') AS text
    FROM (SELECT doc_id, s, unnest(range(0, len(s), 2)) AS st
          FROM (SELECT doc_id, list(sentence ORDER BY pos) AS s FROM a_sentences GROUP BY doc_id))""")

# --- indexes ---
for _c in ("fixed", "sentwin"):
    cte(f"{_c}_tokens", (_c,), f"SELECT chunk_id, doc_id, {index_tokens('text')} AS tokens FROM {_c}")
    cte(f"{_c}_stats", (f"{_c}_tokens",),
        f"SELECT count(*) AS n_chunks, avg(len(tokens)) AS avgdl FROM {_c}_tokens")
    cte(f"{_c}_postings", (f"{_c}_tokens",), f"""
    SELECT term, chunk_id, doc_id, dl, count(*) AS tf
    FROM (SELECT chunk_id, doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM {_c}_tokens) GROUP BY ALL""")
    cte(f"{_c}_vocab", (f"{_c}_postings", f"{_c}_stats"), f"""
    SELECT term, df, ln((n_chunks - df + 0.5) / (df + 0.5) + 1.0) AS idf
    FROM (SELECT term, count(*) AS df FROM {_c}_postings GROUP BY term), {_c}_stats""")
    cte(f"{_c}_hashed", (_c,), f"""
    SELECT chunk_id, bucket, count(*) AS n FROM (
      SELECT chunk_id, ('0x' || substr(md5(token), 1, 2))::INT % {HASH_DIMS} AS bucket
      FROM (SELECT chunk_id, unnest({overlap_tokens('text')}) AS token FROM {_c})) GROUP BY ALL""")

cte("question_terms", ("questions",), f"""
    SELECT qid, term, count(*) AS qtf
    FROM (SELECT qid, unnest({index_tokens('question')}) AS term FROM questions) GROUP BY ALL""")
V = [f"v{j}" for j in range(1, latent.DIMS + 1)]


def columns(template: str) -> str:
    """One expression per dimension; {v} is its column."""
    return ", ".join(template.format(v=v) + f" AS {v}" for v in V)


def orthonormalised(name: str, source: str) -> str:
    """Gram-Schmidt over the columns of *source* (term, v1, ...), one dimension after another."""
    for j, v in enumerate(V):
        before = V[:j]
        shares = ", ".join(f"sum({u} * {v}) AS r{i}" for i, u in enumerate(before)) or "count(*) AS n"
        rest = "".join(f" - r{i} * {u}" for i, u in enumerate(before))
        cte(f"{name}_{v}_shares", (source,), f"SELECT {shares} FROM {source}")
        source = cte(f"{name}_{v}", (source, f"{name}_{v}_shares"), f"""
        SELECT * REPLACE ({v} / sqrt(sum({v} * {v}) OVER ()) AS {v})
        FROM (SELECT term, {', '.join(f'{v}{rest} AS {v}' if u == v else u for u in V)} FROM {source}, {name}_{v}_shares)""")
    return source


def weight_rows(name: str, counts: str, key: str, features: str) -> str:
    """Normalised weights of (key, term, tf) over the features."""
    return cte(name, (counts, features), f"""
    SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w
    FROM (SELECT {key}, term, (1 + ln(tf)) * idf AS w FROM {counts} JOIN {features} USING (term))""")


for _c in ("fixed", "sentwin"):
    cte(f"{_c}_features", (f"{_c}_vocab",), f"SELECT term, idf FROM {_c}_vocab ORDER BY df DESC, term LIMIT {latent.FEATURES}")
    weight_rows(f"{_c}_weights", f"{_c}_postings", "chunk_id", f"{_c}_features")
    _draws = ", ".join(
        f"('0x' || substr(d{j // 4}, {8 * (j % 4) + 1}, 8))::BIGINT / 4294967296.0::DOUBLE - 0.5::DOUBLE AS {v}" for j, v in enumerate(V))
    _digests = ", ".join(f"md5('{latent.SEED}|latent|{b}|' || term) AS d{b}" for b in range(-(-latent.DIMS // 4)))
    _basis = orthonormalised(f"{_c}_b0", cte(
        f"{_c}_start", (f"{_c}_features",), f"SELECT term, {_draws} FROM (SELECT term, {_digests} FROM {_c}_features)"))
    for _i in range(latent.ITERATIONS):
        cte(f"{_c}_c{_i}", (f"{_c}_weights", _basis), f"""
        SELECT chunk_id, {columns('sum(w * {v})')} FROM {_c}_weights JOIN {_basis} USING (term) GROUP BY chunk_id""")
        _basis = orthonormalised(f"{_c}_b{_i + 1}", cte(f"{_c}_t{_i}", (f"{_c}_weights", f"{_c}_c{_i}"), f"""
        SELECT term, {columns('sum(w * {v})')} FROM {_c}_weights JOIN {_c}_c{_i} USING (chunk_id) GROUP BY term"""))
    weight_rows(f"{_c}_asked", "question_counts", "qid", f"{_c}_features")
    _norm = "sqrt(" + " + ".join(f"{v} * {v}" for v in V) + ")"
    for _name, _source, _key in ((f"{_c}_vectors", f"{_c}_weights", "chunk_id"), (f"{_c}_question_vectors", f"{_c}_asked", "qid")):
        cte(_name, (_source, _basis), f"""
        SELECT {_key}, {columns('({v} / n)::FLOAT::DOUBLE')} FROM (
          SELECT *, CASE WHEN {_norm} = 0 THEN 1 ELSE {_norm} END AS n FROM (
            SELECT {_key}, {columns('sum(w * {v})')} FROM {_source} JOIN {_basis} USING (term) GROUP BY {_key}))""")

cte("question_counts", ("question_terms",), "SELECT qid, term, qtf AS tf FROM question_terms")


# --- runs: qid, rank, chunk_id, doc_id, score, retriever ---
def ranked(name: str, needs: tuple[str, ...], scores: str, k: int, retriever: str) -> str:
    return cte(name, needs, f"""
    SELECT qid, rank, chunk_id, doc_id, score, {retriever} AS retriever FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank
      FROM (SELECT * REPLACE (round(score, 9) AS score) FROM ({scores}))) WHERE rank <= {k}""")


def bm25_run(chunks: str, k: int, k1: float = 1.5, b: float = 0.75, terms: str = "question_terms",
             retriever: str = "'bm25'") -> str:
    name = f"bm25_{chunks}_{k}_{str(k1).replace('.', '')}_{str(b).replace('.', '')}_{terms}"
    return ranked(name, (f"{chunks}_postings", f"{chunks}_vocab", f"{chunks}_stats", terms), f"""
        SELECT qid, chunk_id, doc_id, sum(qtf * idf * (tf * ({k1}::DOUBLE + 1)
               / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * dl / avgdl)))) AS score
        FROM {terms} JOIN {chunks}_vocab USING (term) JOIN {chunks}_postings USING (term), {chunks}_stats
        GROUP BY qid, chunk_id, doc_id""", k, retriever)


def dense_run(chunks: str, k: int) -> str:
    product = " + ".join(f"a.{v} * b.{v}" for v in V)
    return ranked(f"dense_{chunks}_{k}", (f"{chunks}_vectors", f"{chunks}_question_vectors", "questions", chunks), f"""
        SELECT q.qid, c.chunk_id, c.doc_id, coalesce({product}, 0.0) AS score
        FROM (SELECT DISTINCT qid FROM questions) q CROSS JOIN {chunks} c
        LEFT JOIN {chunks}_question_vectors a ON a.qid = q.qid LEFT JOIN {chunks}_vectors b ON b.chunk_id = c.chunk_id""",
                  k, "'dense'")


def rrf_run(chunks: str, k: int) -> str:
    children = (bm25_run(chunks, 3 * k), dense_run(chunks, 3 * k))
    union = " UNION ALL ".join(f"SELECT * FROM {c}" for c in children)
    return ranked(f"rrf_{chunks}_{k}", children, f"""
        SELECT qid, chunk_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM ({union})
        GROUP BY qid, chunk_id, doc_id""", k, "'hybrid_rrf'")


def weighted_run(chunks: str, k: int, weights: tuple[float, float]) -> str:
    children = (bm25_run(chunks, 3 * k), dense_run(chunks, 3 * k))
    union = " UNION ALL ".join(f"SELECT *, {w}::DOUBLE AS w FROM {c}" for c, w in zip(children, weights))
    return ranked(f"weighted_{chunks}_{k}", children, f"""
        SELECT qid, chunk_id, doc_id, sum(w * scaled) AS score FROM (
          SELECT *, (score - min(score) OVER l) / (max(score) OVER l - min(score) OVER l + 1e-9::DOUBLE) AS scaled
          FROM ({union}) WINDOW l AS (PARTITION BY qid, retriever)) GROUP BY qid, chunk_id, doc_id""",
                  k, "'hybrid_weighted'")


def pair_features(run: str, chunks: str) -> str:
    """A run with the features x0 to x3 of its pairs."""
    def share(asked: str, held: str) -> str:
        return f"coalesce(len(list_intersect({asked}, {held}))::DOUBLE / nullif(len(list_distinct({asked})), 0), 0)"

    def neighbours(words: str) -> str:
        return f"list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1])"

    return cte(f"features_{run}", (run, chunks, "questions"), f"""
    SELECT * EXCLUDE (q, p, qq, pp), 1.0::DOUBLE AS x0, {share('q', 'p')} AS x1, {share('qq', 'pp')} AS x2,
           coalesce(len(q)::DOUBLE / nullif(len(q) + len(p), 0), 0) AS x3
    FROM (SELECT *, {neighbours('q')} AS qq, {neighbours('p')} AS pp FROM (
      SELECT r.*, {overlap_tokens('question')} AS q, {overlap_tokens('text')} AS p FROM {run} r
      JOIN {chunks} c USING (chunk_id) JOIN questions USING (qid)))""")


def pair_logits(run: str, chunks: str) -> str:
    features = pair_features(run, chunks)
    odds = " + ".join(f"x{i} * ({w}::DOUBLE)" for i, w in enumerate(PRIOR_WEIGHTS))
    return cte(f"logits_{run}", (features,), f"SELECT *, {odds} AS logit FROM {features}")


def fitted_weights(run: str, chunks: str) -> str:
    """One row w0 to w3: gradient ascent on the training questions' pairs of a run."""
    features, odds = pair_features(run, chunks), " + ".join(f"x{i} * w{i}" for i in range(4))
    pairs = cte("judged_pairs", (features, "qrels"), f"""
    SELECT *, 0.5 / count(*) OVER (PARTITION BY y) AS mass FROM (
      SELECT f.*, (r.qid IS NOT NULL)::INT AS y FROM {features} f
      LEFT JOIN (SELECT DISTINCT qid, doc_id FROM qrels) r ON r.qid = f.qid AND r.doc_id = f.doc_id
      WHERE left(md5(f.qid), 1) > '2')""")
    step = cte("weights_0", (pairs,), "SELECT " + ", ".join(f"{w}::DOUBLE AS w{i}" for i, w in enumerate(PRIOR_WEIGHTS)))
    for t in range(1, FIT_STEPS + 1):
        moved = ", ".join(f"any_value(w{i}) + {FIT_RATE} * (sum(e * x{i}) - {FIT_RIDGE} * any_value(w{i})) AS w{i}" for i in range(4))
        step = cte(f"weights_{t}", (pairs, step), f"""
        SELECT {moved} FROM (SELECT *, mass * (y - 1 / (1 + exp(-({odds})))) AS e FROM {pairs}, {step})""")
    return step


def rerank_fitted_run(train: str, run: str, chunks: str, k: int = 5) -> str:
    features, weights = pair_features(run, chunks), fitted_weights(train, chunks)
    odds = " + ".join(f"x{i} * w{i}" for i in range(4))
    return ranked(f"rerank_fitted_{run}_{k}", (features, weights), f"""
        SELECT qid, chunk_id, doc_id, retriever AS first_stage, 1 / (1 + exp(-greatest(-88.0, least(88.0, {odds})))) AS score
        FROM {features}, {weights}""", k, "'rerank(' || first_stage || ')'")


def rerank_run(run: str, chunks: str, k: int = 5) -> str:
    logits = pair_logits(run, chunks)
    return ranked(f"rerank_{run}_{k}", (logits,), f"""
        SELECT qid, chunk_id, doc_id, retriever AS first_stage,
               1 / (1 + exp(-greatest(-88.0, least(88.0, logit)))) AS score FROM {logits}""",
                  k, "'rerank(' || first_stage || ')'")


BM25 = bm25_run("fixed", 10)
RRF = rrf_run("fixed", 10)
DENSE = dense_run("fixed", 10)

# --- expansion ---
FEEDBACK = bm25_run("fixed", 5)
cte("feedback_terms", (FEEDBACK, "fixed_tokens", "question_terms"), f"""
    SELECT qid, position, term, tf FROM (
      SELECT qid, term, tf, row_number() OVER (PARTITION BY qid ORDER BY tf DESC, first_seen) AS position FROM (
        SELECT qid, term, count(*) AS tf, min(rank * 1000000 + pos) AS first_seen FROM (
          SELECT qid, rank, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS pos
          FROM {FEEDBACK} JOIN fixed_tokens USING (chunk_id)) GROUP BY qid, term) f
      WHERE NOT EXISTS (SELECT 1 FROM question_terms t WHERE t.qid = f.qid AND t.term = f.term))
    WHERE position <= 8""")
cte("expanded", ("questions", "feedback_terms"), """
    SELECT q.qid, CASE WHEN added IS NULL THEN question ELSE question || ' ' || added END AS question
    FROM questions q LEFT JOIN (
      SELECT qid, string_agg(term, ' ' ORDER BY position) AS added FROM feedback_terms GROUP BY qid) USING (qid)""")
cte("expanded_terms", ("expanded",), f"""
    SELECT qid, term, count(*) AS qtf
    FROM (SELECT qid, unnest({index_tokens('question')}) AS term FROM expanded) GROUP BY ALL""")
RM3 = bm25_run("fixed", 10, terms="expanded_terms", retriever="'rm3+bm25'")

# --- answers ---
def budgeted(source: str, entry: str, width: int, keep_rest: bool) -> str:
    """Entries with the characters used before them, and the first that does not fit."""
    return f"""
    SELECT *, min(CASE WHEN used > 0 AND used + length(entry) > {width} THEN rank END) OVER (PARTITION BY qid) AS cut
    FROM (SELECT qid, rank, entry, coalesce(sum(length(entry) + 1) OVER (PARTITION BY qid ORDER BY rank
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
          FROM (SELECT qid, rank, {entry} AS entry FROM {source}) WHERE {'true' if keep_rest else "entry <> ''"})"""


def answer_ctes(run: str, prefix: str = "") -> None:
    """evidence, scored_sentences, answers, premise and entailed over a run, named with the prefix."""
    cte(f"{prefix}evidence", (run, "fixed"), f"SELECT r.*, c.text FROM {run} r JOIN fixed c USING (chunk_id)")
    cte(f"{prefix}scored_sentences", (f"{prefix}evidence", "questions"), f"""
    SELECT qid, rank, pos, sentence, {jaccard('q', 's')} AS overlap FROM (
      SELECT qid, rank, pos, sentence, {overlap_tokens('question')} AS q, {overlap_tokens('sentence')} AS s
      FROM (SELECT qid, rank, unnest(parts) AS sentence, generate_subscripts(parts, 1) - 1 AS pos
            FROM (SELECT qid, rank, {b_sentences('text')} AS parts FROM {prefix}evidence)) JOIN questions USING (qid))""")
    cte(f"{prefix}answers", (f"{prefix}scored_sentences",), f"""
    SELECT qid, string_agg(sentence, ' ' ORDER BY place) AS text FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, rank, pos) AS place
      FROM {prefix}scored_sentences) WHERE place <= 2 GROUP BY qid""")
    cte(f"{prefix}budget_premise", (f"{prefix}evidence",), budgeted(f"{prefix}evidence", stripped("text"), 1500, False))
    cte(f"{prefix}premise", (f"{prefix}budget_premise",), f"""
    SELECT qid, string_agg(CASE WHEN rank = cut THEN left(entry, (1500 - used)::BIGINT) ELSE entry END, ' ' ORDER BY rank)
           AS premise
    FROM {prefix}budget_premise WHERE cut IS NULL OR rank < cut OR (rank = cut AND 1500 - used > 20) GROUP BY qid""")
    negated = (f"(len(list_filter(w, lambda x: x IN {NEGATIONS})) + len(regexp_extract_all(lower(sentence), "
               f"'{SHORT_NEGATION.replace(chr(39), chr(39) * 2)}'))) % 2 = 1")
    numbers = f"list_filter(w, lambda x: regexp_matches(x, '{NUMBER}'))"
    for name, source, column in (("held", "premise", "premise"), ("asked", "answers", "text")):
        cte(f"{prefix}{name}_sentences", (f"{prefix}{source}",), f"""
    SELECT qid, i, w, {negated} AS negated, {numbers} AS numbers FROM (
      SELECT qid, i, sentence, {overlap_tokens('sentence')} AS w FROM (
        SELECT qid, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS i
        FROM (SELECT qid, {b_sentences(column)} AS parts FROM {prefix}{source})))""")
    cte(f"{prefix}weighed", (f"{prefix}asked_sentences", f"{prefix}held_sentences"), f"""
    SELECT a.*, list_transform(w, lambda x: ln(1 + (coalesce(len(ws), 0) + 1)::DOUBLE
             / (1 + len(list_filter(coalesce(ws, []), lambda s: list_contains(s, x)))))) AS weights
    FROM {prefix}asked_sentences a LEFT JOIN (SELECT qid, list(w) AS ws FROM {prefix}held_sentences GROUP BY qid) USING (qid)""")
    cte(f"{prefix}supported", (f"{prefix}weighed", f"{prefix}held_sentences"), f"""
    SELECT qid, i, any_value(n) AS n, max_by(clash, (share, -place)) AS clash, max(share) AS share FROM (
      SELECT a.qid, a.i, len(a.w) AS n, h.i AS place,
        coalesce(a.negated <> h.negated OR (len(list_filter(a.numbers, lambda x: NOT list_contains(h.numbers, x))) > 0
          AND len(list_filter(h.numbers, lambda x: NOT list_contains(a.numbers, x))) > 0), false) AS clash,
        CASE WHEN len(a.w) = 0 OR len(h.w) = 0 THEN 0.0 ELSE
          list_max(list_reduce(
            list_concat([list_transform(h.w, lambda x: 0.0::DOUBLE)],
              list_transform(range(1, len(a.w) + 1), lambda k: list_transform(h.w, lambda x: CASE WHEN x = a.w[k] THEN a.weights[k] ELSE -1.0::DOUBLE END))),
            lambda best, m: list_transform(range(1, len(m) + 1), lambda j: CASE WHEN m[j] > 0
              THEN greatest(best[j], m[j] + coalesce(list_max(best[1:j - 1]), 0.0)) ELSE best[j] END)))
          / list_reduce(a.weights, lambda x, y: x + y) END AS share
      FROM {prefix}weighed a LEFT JOIN {prefix}held_sentences h USING (qid)) GROUP BY qid, i""")
    cte(f"{prefix}entailed", (f"{prefix}supported",), f"""
    SELECT qid, CASE WHEN n = 0 THEN 1.0 / 3 ELSE exp(CASE WHEN clash THEN -f ELSE o END) / (exp(o) + exp(-f) + 1) END AS p
    FROM (SELECT qid, n, clash, ln(s / (1 - s)) AS o, ln((1 - {OVERLAP_CLAMP}) / {OVERLAP_CLAMP}) AS f
          FROM (SELECT qid, n, clash, {clamped('share')} AS s FROM {prefix}supported))""")


answer_ctes(FEEDBACK)
cte("budget_context", ("evidence",),
    budgeted("evidence", f"'[' || rank || '] ' || {stripped('text')}", 4000, True))
cte("context", ("budget_context",), """
    SELECT qid, string_agg(entry, chr(10) ORDER BY rank) AS context
    FROM budget_context WHERE cut IS NULL OR rank < cut GROUP BY qid""")
# --- evaluation ---
cte("qrels", ("questions", "docs"),
    "SELECT qid, doc_id FROM questions JOIN docs ON contains(docs.text, questions.passage)")
KS = (1, 3, 5, 10)


def metrics_of(run: str) -> str:
    """qid and every metric, for every question."""
    cte(f"ranking_{run}", (run,), f"""
    SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY first_rank) AS doc_rank
    FROM (SELECT qid, doc_id, min(rank) AS first_rank FROM {run} GROUP BY qid, doc_id)""")
    cte(f"judged_{run}", (f"ranking_{run}", "qrels"), f"""
    SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY doc_rank) AS hits FROM (
      SELECT r.*, CASE WHEN j.doc_id IS NULL THEN 0 ELSE 1 END AS rel
      FROM ranking_{run} r LEFT JOIN qrels j ON j.qid = r.qid AND j.doc_id = r.doc_id)""")
    cuts = []
    for k in KS:
        hits = f"count(*) FILTER (WHERE rel = 1 AND doc_rank <= {k})"
        dcg = f"sum(CASE WHEN rel = 1 AND doc_rank <= {k} THEN 1 / log2(doc_rank + 1) ELSE 0 END)"
        ideal = f"list_sum(list_transform(range(1, least({k}, n_rel) + 1), lambda i: 1 / log2(i + 1)))"
        cuts += [f"CASE WHEN {hits} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_rate_at_{k}",
                 f"{hits} / any_value(n_rel)::DOUBLE AS recall_at_{k}",
                 f"{hits} / {k}::DOUBLE AS precision_at_{k}",
                 f"{dcg} / any_value({ideal}) AS ndcg_at_{k}"]
    columns = [c.rsplit(" AS ", 1)[1] for c in cuts] + ["mrr", "map"]
    cte(f"scored_{run}", (f"judged_{run}", "qrels"), f"""
    SELECT qid, {', '.join(cuts)},
           1.0 / min(CASE WHEN rel = 1 THEN doc_rank END) AS mrr,
           sum(CASE WHEN rel = 1 THEN hits / doc_rank::DOUBLE END) / any_value(n_rel) AS map
    FROM judged_{run} JOIN (SELECT qid, count(DISTINCT doc_id) AS n_rel FROM qrels GROUP BY qid) USING (qid)
    GROUP BY qid""")
    zeros = ", ".join(f"coalesce({c}, 0.0)::DOUBLE AS {c}" for c in columns)
    return cte(f"metrics_{run}", (f"scored_{run}", "questions"),
               f"SELECT qid, {zeros} FROM questions LEFT JOIN scored_{run} USING (qid)")


def long_metrics(run: str) -> str:
    wide = metrics_of(run)
    return cte(f"long_{run}", (wide,), f"""
    SELECT qid, replace(name, '_at_', '@') AS metric, value
    FROM (UNPIVOT {wide} ON COLUMNS(* EXCLUDE (qid)) INTO NAME name VALUE value)""")


cte("reading_rows", ("docs",), "SELECT doc_id::BIGINT AS src_pos, substr(sha1(text), 1, 12) AS content_id, text, "
    "source AS title, string_split(text, ' ') AS w FROM docs")
cte("kept_docs", ("reading_rows",), """
    SELECT content_id, arg_min(title, src_pos) AS title, arg_min(text, src_pos) AS text, min(src_pos) AS src_pos
    FROM reading_rows GROUP BY content_id""")

RUN = "qid, rank, chunk_id, doc_id, round(score, 6) AS score, retriever"


def _run_oracle(run: str) -> str:
    return with_ctes((run,), f"SELECT {RUN} FROM {run}")


def _summary(group: str, value: str, source: str) -> str:
    return (f"SELECT {group}, round(avg({value}), 6) AS mean, round(stddev_pop({value}), 6) AS std, "
            f"round(quantile_cont({value}, 0.5), 6) AS p50, round(quantile_cont({value}, 0.95), 6) AS p95 "
            f"FROM {source} GROUP BY {group}")


def _hash_words(label: str, blocks: int, source: str) -> str:
    """metric, value, block, place and 32-bit word of every digest of the rows (metric, qid, value)."""
    return (f"SELECT metric, value, block, place, ('0x' || substr(md5('42|{label}|' || block || '|' || qid), 8 * place + 1, 8))::BIGINT "
            f"AS word FROM {source}, range({blocks}) b(block), range(4) p(place)")


def _bootstrap_oracle(values: str) -> str:
    weight = " + ".join(f"(word >= {step})::INT" for step in POISSON_STEPS)
    return with_ctes((values,), f"""
        SELECT metric, round(any_value(mean), 6) AS mean, round(quantile_cont(coalesce(drawn, mean), 0.025), 6) AS ci_lo,
               round(quantile_cont(coalesce(drawn, mean), 0.975), 6) AS ci_hi
        FROM (SELECT metric, sum(weight * value) / nullif(sum(weight), 0) AS drawn
              FROM (SELECT metric, value, block, place, {weight} AS weight FROM ({_hash_words('bootstrap', 500, values)}))
              GROUP BY metric, block, place)
        JOIN (SELECT metric, avg(value) AS mean FROM {values} GROUP BY metric) USING (metric) GROUP BY metric""")


def _permutation_oracle(a: str, b: str) -> str:
    pairs = f"(SELECT metric, qid, a.value - b.value AS value FROM {a} a JOIN {b} b USING (qid, metric))"
    return with_ctes((a, b), f"""
        SELECT metric, any_value(n) AS n, round(any_value(delta), 6) AS delta,
               round(greatest(avg((abs(drawn) >= abs(delta) - 1e-12)::INT), 1e-4), 6) AS p_value
        FROM (SELECT metric, avg((2 * ((word >> bit) & 1) - 1) * value) AS drawn
              FROM ({_hash_words('permutation', 79, pairs)}), range(32) t(bit)
              WHERE (block * 4 + place) * 32 + bit < 10000 GROUP BY metric, block, place, bit)
        JOIN (SELECT metric, avg(value) AS delta, count(*) AS n FROM {pairs} GROUP BY metric) USING (metric) GROUP BY metric""")


def _metric_oracle(*columns: str) -> str:
    wide = metrics_of(BM25)
    return with_ctes((wide,), f"SELECT qid, {', '.join(f'round({c}, 6) AS {c}' for c in columns)} FROM {wide}")


def _setup_oracle(runs: dict[str, str]) -> str:
    parts, needs = [], []
    for setup, run in runs.items():
        needs.append(metrics_of(run))
        parts.append(f"SELECT '{setup}' AS setup, round(avg(ndcg_at_5), 6) AS ndcg5_mean, "
                     f"round(avg(recall_at_5), 6) AS recall5_mean, round(avg(mrr), 6) AS mrr_mean, "
                     f"round(avg(recall_at_10), 6) AS recall10_mean FROM {needs[-1]}")
    return with_ctes(tuple(needs), "\nUNION ALL ".join(parts))


def _ablation_runs() -> dict[str, str]:
    makers = {"bm25": bm25_run, "dense": dense_run, "hybrid_rrf": rrf_run}
    runs = {}
    for chunks in ("fixed", "sentwin"):
        for name, make in makers.items():
            runs[f"{name}_{chunks}"] = make(chunks, 10)
            runs[f"{name}_{chunks}+rerank"] = rerank_run(make(chunks, 30), chunks)
    return runs


def _ablation_table() -> str:
    """Intervals of three metrics per cell: every cell's questions are drawn by their own ids."""
    parts = {label: long_metrics(run) for label, run in _ablation_runs().items()}
    union = " UNION ALL ".join(
        f"SELECT '{label}|' || metric AS metric, qid, value FROM {long} WHERE metric IN ('ndcg@5', 'recall@5', 'mrr')"
        for label, long in parts.items())
    cte("ablation_values", tuple(parts.values()), union)
    return f"""SELECT string_split(metric, '|')[1] AS label, string_split(metric, '|')[2] AS metric, mean, ci_lo, ci_hi
               FROM ({_bootstrap_oracle('ablation_values')})"""


# every vector searched among all vectors, as one row per (question, vector, dimension)
_UNIT = ("SELECT vec_id::VARCHAR AS id, label, list_transform(embedding, lambda x: x::DOUBLE / "
         "sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings")
cte("unit_vectors", (), _UNIT)
ranked("dense_embeddings", ("unit_vectors",), """
    SELECT a.id AS qid, b.id AS chunk_id, b.label::VARCHAR AS doc_id, list_dot_product(a.v, b.v) AS score
    FROM unit_vectors a CROSS JOIN unit_vectors b""", 10, "'dense'")


def _bm25_conversations() -> str:
    cte("turn_terms", (), f"""
    SELECT qid, term, count(*) AS qtf FROM (
      SELECT conv_id || '-' || turn AS qid, unnest({index_tokens('text')}) AS term
      FROM conversations WHERE role = 'user') GROUP BY ALL""")
    return _run_oracle(bm25_run("fixed", 5, terms="turn_terms"))


def _tokens(expression: str) -> str:
    return with_ctes(("docs",), "SELECT doc_id, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens "
                     f"FROM (SELECT doc_id, {expression} AS t FROM docs)")


def _stem(t: str) -> str:
    """The suffix rules over one token; RE2 has no back-references, so letters are compared."""
    def ends(suffix: str, root: int) -> str:
        return f"suffix({t}, '{suffix}') AND length({t}) >= {root + len(suffix)}"

    def cut(n: int) -> str:
        return f"left({t}, length({t}) - {n})"

    def repaired(n: int) -> str:
        root = cut(n)
        doubled = (f"right({root}, 1) = left(right({root}, 2), 1) "
                   f"AND regexp_matches({root}, '[^aeiou]$')")
        return (f"CASE WHEN {doubled} THEN {cut(n + 1)} "
                f"WHEN regexp_matches({root}, '[aeiou][^aeiou]$') THEN {root} || 'e' ELSE {root} END")

    return (f"CASE WHEN length({t}) <= 3 THEN {t} WHEN {ends('ness', 4)} THEN {cut(4)} "
            f"WHEN {ends('tion', 3)} OR {ends('sion', 3)} THEN {cut(4)} "
            f"WHEN {ends('ing', 3)} THEN {repaired(3)} WHEN {ends('ed', 3)} THEN {repaired(2)} "
            f"WHEN {ends('er', 3)} OR {ends('ly', 3)} THEN {cut(2)} WHEN {ends('ies', 3)} THEN {cut(3)} || 'y' "
            f"WHEN {ends('es', 3)} AND regexp_matches({t}, '([sxz]|ch|sh)es$') THEN {cut(2)} "
            f"WHEN {ends('s', 4)} AND NOT suffix({t}, 'ss') THEN {cut(1)} ELSE {t} END")


def oracle_sql() -> dict[str, str]:
    answer_ctes(rerank_run(rrf_run("fixed", 15), "fixed"), "engine_")
    bm25_metrics, rrf_metrics, dense_metrics = long_metrics(BM25), long_metrics(RRF), long_metrics(DENSE)
    rerank = rerank_run(rrf_run("fixed", 30), "fixed")
    logits = pair_logits(RRF, "fixed")
    weights = fitted_weights(RRF, "fixed")
    sentence_run = bm25_run("sentwin", 10)
    index = index_tokens("text")
    return {
        "normalized_text": with_ctes(("docs",), f"SELECT doc_id, {normalized('text')} AS normalized FROM docs"),
        "word_tokens": _tokens(words_of(normalized("text"))),
        "index_tokens": _tokens(index),
        "stemmed_tokens": _tokens(f"list_transform({index}, lambda w: {_stem('w')})"),
        "sentences_for_chunking": with_ctes(("a_sentences",), "SELECT doc_id, pos::BIGINT AS pos, sentence FROM a_sentences"),
        "sentences_for_answers": with_ctes(("docs",), f"""
            SELECT doc_id, (generate_subscripts(p, 1) - 1)::BIGINT AS pos, unnest(p) AS sentence
            FROM (SELECT doc_id, {b_sentences('text')} AS p FROM docs)"""),
        "content_ids": with_ctes(("docs",), "SELECT doc_id, substr(sha1(text), 1, 12) AS content_id FROM docs"),
        "snippets": with_ctes(("docs",), """
            SELECT doc_id, replace(substr(text, 1, 120), chr(10), ' ')
                   || CASE WHEN length(text) > 120 THEN '…' ELSE '' END AS snippet FROM docs"""),
        "fixed_chunks": with_ctes(("fixed",), "SELECT *, 'fixed' AS chunker FROM fixed"),
        "small_fixed_chunks": with_ctes(("small_fixed",), """
            SELECT chunk_id, doc_id, index, word_start, word_end, 'fixed' AS chunker FROM small_fixed"""),
        "sentence_window_chunks": with_ctes(("sentwin",), "SELECT *, 'sentence_window' AS chunker FROM sentwin"),
        "chunk_lengths": with_ctes(("fixed_tokens",), "SELECT chunk_id, len(tokens)::BIGINT AS dl FROM fixed_tokens"),
        "corpus_statistics": with_ctes(("fixed_stats",), "SELECT n_chunks, round(avgdl, 6) AS avgdl FROM fixed_stats"),
        "postings": with_ctes(("fixed_postings",), "SELECT term, chunk_id, tf, dl::BIGINT AS dl FROM fixed_postings"),
        "vocabulary": with_ctes(("fixed_vocab",), "SELECT term, df, round(idf, 6) AS idf FROM fixed_vocab"),
        "question_terms": with_ctes(("question_terms",), "SELECT qid, term, qtf FROM question_terms"),
        "bm25_search": _run_oracle(BM25),
        "bm25_other_parameters": _run_oracle(bm25_run("fixed", 10, 1.2, 0.5)),
        "bm25_sentence_windows": _run_oracle(sentence_run),
        "bm25_shuffled_terms": _run_oracle(BM25),
        "bm25_pruned_search": _run_oracle(BM25),
        "bm25_conversations": _bm25_conversations(),
        "l2_normalized": """
            SELECT vec_id, (generate_subscripts(v, 1) - 1)::BIGINT AS pos, round(unnest(v), 6) AS value FROM (
              SELECT vec_id, list_transform(s, lambda x: x / sqrt(list_sum(list_transform(s, lambda y: y * y)))) AS v
              FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id + 1)) AS s FROM embeddings))""",
        "dense_embeddings": _run_oracle("dense_embeddings"),
        "dense_embeddings_grid": _run_oracle("dense_embeddings"),
        "latent_vectors": with_ctes(("fixed_vectors", "fixed"), f"""
            SELECT chunk_id, substr(name, 2)::BIGINT - 1 AS pos, round(value, 6) AS value
            FROM (UNPIVOT (SELECT chunk_id, {columns('coalesce({v}, 0)')} FROM fixed LEFT JOIN fixed_vectors USING (chunk_id)) ON {', '.join(V)} INTO NAME name VALUE value)"""),
        "fitted_pair_weights": with_ctes((weights,), f"""
            SELECT substr(name, 2)::BIGINT AS feature, round(value, 6) AS weight
            FROM (UNPIVOT {weights} ON w0, w1, w2, w3 INTO NAME name VALUE value)"""),
        "rerank_fitted": _run_oracle(rerank_fitted_run(RRF, rrf_run("fixed", 30), "fixed")),
        "hashed_counts": with_ctes(("fixed_hashed",), f"""
            SELECT c.chunk_id, b.bucket::BIGINT AS bucket, coalesce(n, 0)::DOUBLE AS n
            FROM fixed c CROSS JOIN (SELECT unnest(range({HASH_DIMS})) AS bucket) b
            LEFT JOIN fixed_hashed h ON h.chunk_id = c.chunk_id AND h.bucket = b.bucket"""),
        "dense_search": _run_oracle(DENSE),
        "hybrid_rrf": _run_oracle(RRF),
        "hybrid_weighted": _run_oracle(weighted_run("fixed", 10, (0.8, 0.2))),
        "rm3_terms": with_ctes(("feedback_terms",), "SELECT qid, position, term, tf FROM feedback_terms"),
        "rm3_questions": with_ctes(("expanded",), "SELECT qid, question FROM expanded"),
        "bm25_rm3_search": _run_oracle(RM3),
        "pair_scores": with_ctes((logits,), f"SELECT qid, chunk_id, round(logit, 6) AS logit FROM {logits}"),
        "rerank_hybrid": _run_oracle(rerank),
        "sentence_overlap": with_ctes(("scored_sentences",), """
            SELECT qid, rank, pos::BIGINT AS pos, round(overlap, 6) AS overlap FROM scored_sentences"""),
        "extractive_answers": with_ctes(("questions", "answers", "evidence"), """
            SELECT qid, coalesce(text, '') AS text, coalesce(n, 0)::BIGINT AS n_supporting, 'extractive' AS generator
            FROM questions LEFT JOIN answers USING (qid)
            LEFT JOIN (SELECT qid, count(*) AS n FROM evidence GROUP BY qid) USING (qid)"""),
        "context_blocks": with_ctes(("context",), "SELECT qid, context FROM context"),
        "premises": with_ctes(("premise",), "SELECT qid, premise FROM premise"),
        "faithfulness": with_ctes(("entailed", "answers"), """
            SELECT qid, round(coalesce(avg(p), 0.0), 6) AS faithfulness
            FROM answers LEFT JOIN entailed USING (qid) GROUP BY qid"""),
        "search_display": with_ctes(("evidence",), """
            SELECT qid, rank, round(score, 5) AS score, doc_id, chunk_id, retriever,
                   replace(substr(text, 1, 200), chr(10), ' ') AS snippet FROM evidence"""),
        "relevant_documents": with_ctes(("qrels",), "SELECT qid, doc_id FROM qrels"),
        "relevant_counts": with_ctes(("qrels",), "SELECT qid, count(DISTINCT doc_id) AS n_rel FROM qrels GROUP BY qid"),
        "unjudged_questions": with_ctes(("questions", "qrels"), """
            SELECT DISTINCT qid FROM questions q WHERE NOT EXISTS (SELECT 1 FROM qrels r WHERE r.qid = q.qid)"""),
        "document_ranking": with_ctes((metrics_of(BM25), f"ranking_{BM25}"), f"SELECT qid, doc_id, doc_rank FROM ranking_{BM25}"),
        **{f"metric_{m}": _metric_oracle(*[f"{m}_at_{k}" for k in KS]) for m in ("hit_rate", "recall", "precision", "ndcg")},
        "metric_reciprocal_rank": _metric_oracle("mrr"),
        "metric_average_precision": _metric_oracle("map"),
        "metrics_per_question": with_ctes((bm25_metrics,), f"SELECT qid, metric, round(value, 6) AS value FROM {bm25_metrics}"),
        "label_relevance_metrics": with_ctes(("dense_embeddings",), """
            SELECT qid, round(sum((a.label = b.label)::INT) / 10.0::DOUBLE, 6) AS precision_at_10,
                   round(sum((a.label = b.label)::INT)::DOUBLE / any_value(n), 6) AS recall_at_10
            FROM dense_embeddings r JOIN embeddings a ON a.vec_id::VARCHAR = r.qid
            JOIN embeddings b ON b.vec_id::VARCHAR = r.chunk_id
            JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) c ON c.label = a.label GROUP BY qid"""),
        "run_summary": with_ctes((bm25_metrics,), _summary("metric", "value", bm25_metrics)),
        "bootstrap_intervals": _bootstrap_oracle(bm25_metrics),
        "permutation_test": _permutation_oracle(bm25_metrics, dense_metrics),
        "latency_summary": _summary("event_type", "value", "events"),
        "value_percentiles": """
            SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p0,
                   round(quantile_cont(value, 0.95), 6) AS p1 FROM events GROUP BY event_type""",
        "evaluated_run": _bootstrap_oracle(bm25_metrics),
        "run_comparison": _permutation_oracle(bm25_metrics, rrf_metrics),
        "ablation_table": _ablation_table(),
        "engine_answers": with_ctes(("questions", "engine_answers", "engine_evidence", "engine_entailed"), """
            SELECT qid, coalesce(text, '') AS text, coalesce(n, 0)::BIGINT AS n_supporting,
                   round(CASE WHEN text IS NULL THEN 0.0 ELSE coalesce(p, 0.0) END, 6) AS faithfulness
            FROM questions LEFT JOIN engine_answers USING (qid)
            LEFT JOIN (SELECT qid, count(*) AS n FROM engine_evidence GROUP BY qid) USING (qid)
            LEFT JOIN (SELECT qid, avg(p) AS p FROM engine_entailed GROUP BY qid) USING (qid)"""),
        "function_chunks": with_ctes(("docs",), f"""
            SELECT doc_id || '::lines::' || (i - 1) AS chunk_id, doc_id, text, (i - 1)::BIGINT AS index, 'lines' AS chunker FROM (
              SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS i FROM (
                SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS l
                FROM docs WHERE regexp_matches(text, '[^{SPACE}]')))"""),
        "jsonl_round_trip": "SELECT doc_id::VARCHAR AS doc_id, source, md5(text) AS text_md5, true AS in_order FROM documents",
        "compared_runs": with_ctes((bm25_metrics, rrf_metrics), f"""
            SELECT metric, round(avg(a.value - b.value), 6) AS delta, count(*) AS n
            FROM {bm25_metrics} a JOIN {rrf_metrics} b USING (qid, metric) GROUP BY metric"""),
        "default_setup_means": _setup_oracle({
            "bm25_fixed": BM25, "dense_fixed": DENSE, "hybrid_rrf_fixed": RRF, "hybrid_rrf_fixed_rerank": rerank,
            "hybrid_rrf_sentwin": rrf_run("sentwin", 10), "bm25_rm3_fixed": RM3}),
        "ablation_means": _setup_oracle(_ablation_runs()),
        "first_documents": with_ctes(("reading_rows",), """
            SELECT content_id, min(src_pos) AS src_pos, arg_min(title, src_pos) AS title
            FROM reading_rows GROUP BY content_id"""),
        "dataset_documents": with_ctes(("kept_docs",), """
            SELECT content_id AS doc_id, title, 'reading-comprehension' AS source, length(text) AS n_chars FROM kept_docs"""),
        "dataset_questions": with_ctes(("reading_rows", "kept_docs"), """
            SELECT 'q' || src_pos AS qid, array_to_string(w[1:6], ' ') AS question, w[1] AS answer, content_id AS doc_id
            FROM reading_rows"""),
        "dataset_size": "SELECT count(*) AS n_docs, round(avg(length(text)), 6) AS mean_chars FROM documents",
        "questions_linked_by_title": """
            SELECT item_id::VARCHAR AS qid, d.doc_id FROM benchmark LEFT JOIN (
              SELECT source, arg_max(substr(sha1(text), 1, 12), doc_id) AS doc_id FROM documents GROUP BY source) d
            ON d.source = 'src' || item_id""",
    }
