"""DuckDB SQL for every registered query whose result SQL can state, over whole tables.

The statements follow the definitions, not the Spark plans: ranks are windows over all rows, medians
are DuckDB's, n-gram contexts are self-joins.
"""

from __future__ import annotations

# Hand-made lookups: the documents' sentiment words and a few frequent ones. Valid in both engines.
STOPWORDS = ("the", "of", "and", "to", "a", "in", "is")
TOLERANCE = 1e-3  # the library's own
MOST_ITERATIONS = 60


def _values(rows: str) -> str:
    pairs = [line.split() for line in rows.strip().splitlines()]
    listed = ", ".join(f"('{word}', '{label}')" for label, *words in pairs for word in words)
    return f"SELECT word, sentiment FROM (VALUES {listed}) AS t(word, sentiment)"


LEXICONS = {
    "bing": _values(
        """
        negative trash idiot worthless scum moron pathetic clown disgusting stupid loser
        positive best with for
        """
    ),
    "nrc": _values(
        """
        anger trash idiot scum no
        disgust trash scum disgusting
        sadness worthless pathetic loser no
        trust best with
        joy best for
        """
    ),
    "afinn": _values(
        """
        -3 idiot moron scum stupid
        -2 worthless pathetic disgusting loser
        -1 trash clown no
        1 with for
        3 best
        """
    ),
}

# letters, digits and underscores with what joins them; ideographs, hiragana and runs of katakana are set apart first
TOKEN = r"(?:\p{L}[\p{L}\p{M}]*(?:[''’.]\p{L}[\p{L}\p{M}]*)*|\p{N}[\p{N}\p{M}]*(?:[''’.,;]\p{N}[\p{N}\p{M}]*)*|_\p{M}*)+"
APART = r"[\p{Han}\p{Hiragana}]\p{M}*|(?:[\p{Katakana}ー]\p{M}*)+"
NUMBERED = (
    "CASE o_orderkey % 6 WHEN 0 THEN 'Paid ' || o_orderkey || ',000.50; or ' || o_custkey || ',x' "
    "WHEN 1 THEN 'a.' || o_orderkey || ' 3.a v' || o_custkey || '.5' WHEN 2 THEN o_orderkey || '.14 km e.g. U.S.A.' "
    "WHEN 3 THEN 'don''t_' || o_orderkey || ' it’s ' || o_custkey || '’5' WHEN 4 THEN '中文' || o_orderkey || 'かな カタカナー' || o_custkey || '中.文' "
    "ELSE 'naïve, ' || o_orderkey || ';' || o_custkey || ' _x_ é’é 한국어 नमस्ते' END"
)
SPACE = r"[\t\n\f\r\p{Z}]+"

POSTS = """
posts AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS status_id, c.c_name AS screen_name, d.text,
         CAST(o.o_orderdate AS DATE) AS created_at, d.source = 'src0' AS is_quote,
         o.o_orderstatus = 'P' AS is_retweet,
         CAST(floor(o.o_totalprice / 1000) AS BIGINT) AS favorite_count,
         coalesce(l.q, 0) AS retweet_count,
         CAST(floor(greatest(c.c_acctbal, 0)) AS BIGINT) AS followers_count
  FROM documents d LEFT JOIN orders o ON o.o_orderkey = d.doc_id
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN (SELECT l_orderkey, CAST(floor(sum(l_quantity)) AS BIGINT) AS q
             FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = d.doc_id),
marked AS (
  SELECT p.* REPLACE (p.text || ' a.b <b>"café"</b>, \\n @'
         || translate(d.source, '0123456789', 'abcdefghij') || '_9 said' || chr(10)
         || 'see https://t.co/' || p.status_id || ' tail' || chr(10) || 'end' AS text)
  FROM posts p JOIN documents d ON CAST(d.doc_id AS VARCHAR) = p.status_id)"""

RAW = "screen_name, text, is_quote, is_retweet, favorite_count, retweet_count, followers_count, status_id"
METRICS_LONG = """
long AS (
  SELECT status_id, is_retweet, text, 'favorite_count' AS metric, favorite_count AS value FROM posts
  UNION ALL
  SELECT status_id, is_retweet, text, 'retweet_count', retweet_count FROM posts)"""
HIGH, LOW = "High Performing Tweets", "Low Performing Tweets"


def _stripped(text: str = "text") -> str:
    return f"regexp_replace({text}, '(//t.co/)(.*)', ' Link', 'g')"


def _cleaned(text: str = "text") -> str:
    return f"regexp_replace(replace({_stripped(text)}, 'https:', ''), '<[^>]+>', '', 'g')"


def _tokens(text: str) -> str:
    return f"regexp_extract_all(regexp_replace(lower({text}), '({APART})', ' \\1 ', 'g'), '{TOKEN}')"


def _words(source: str, columns: str = "", text: str = "text", out: str = "word") -> str:
    kept = f"{columns}, " if columns else ""
    return f"SELECT {kept}unnest({_tokens(text)}) AS {out} FROM {source}"


def _ngrams(source: str, n: int = 2, columns: str = "", text: str = "text") -> str:
    kept = f"{columns}, " if columns else ""
    grams = f"list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' '))"
    return (
        f"SELECT {kept}unnest({grams}) AS ngram FROM "
        f"(SELECT {kept}{_tokens(text)} AS w FROM {source}) WHERE len(w) >= {n}"
    )


def _pieces(source: str, columns: str = "", text: str = "text") -> str:
    kept = f"{columns}, " if columns else ""
    return (
        f"SELECT * FROM (SELECT {kept}unnest(string_split_regex(lower({text}), '{SPACE}')) AS word FROM {source}) "
        "WHERE word <> ''"
    )


def _handle(word: str = "word") -> str:
    return f"trim(regexp_replace({word}, '[^a-z]', ' ', 'g'))"


def _day(column: str = "created_at") -> str:
    return f"strftime({column}, '%Y-%m-%d')"


def _bucket(division: str) -> str:
    week = "(CAST(floor((dayofyear(created_at) - 1) / 7) AS INTEGER) + 1)"
    return {
        "month": "month(created_at) || '-' || year(created_at)",
        "day": "day(created_at) || '-' || month(created_at) || '-' || year(created_at)",
        "week": f"CAST({week} AS VARCHAR)",
        "biweek": f"CAST(CAST(round_even({week} / 2, 0) AS INTEGER) AS VARCHAR)",
        "week_year": f"{week} || '-' || year(created_at)",
    }[division]


def _no_stopword(column: str = "ngram") -> str:
    listed = ", ".join(f"'{word}'" for word in STOPWORDS)
    return f"NOT list_has_any(string_split({column}, ' '), [{listed}])"


def _posts(*ctes: str, final: str) -> str:
    return "WITH " + ",\n".join([POSTS.strip(), *ctes]) + "\n" + final


def _top(counts: str, n: int, partition: str = "", value: str = "n") -> str:
    over = f"PARTITION BY {partition} " if partition else ""
    return f"SELECT * FROM {counts} QUALIFY rank() OVER ({over}ORDER BY {value} DESC) <= {n}"


def _ngram_counts(n: int, where: str = "true") -> str:
    return _posts(
        f"g AS ({_ngrams('posts', n)})", final=f"SELECT ngram, count(*) AS n FROM g WHERE {where} GROUP BY ngram"
    )


def _sentiment_words(lexicon: str, top: int, unwanted: str) -> str:
    return _posts(
        f"lex AS ({LEXICONS[lexicon]})",
        f"w AS ({_words('posts', text=_stripped())})",
        "c AS (SELECT word, sentiment, count(*) AS n FROM w JOIN lex USING (word) "
        f"WHERE word <> '{unwanted}' GROUP BY word, sentiment)",
        final=_top("c", top, "sentiment"),
    )


def _sentiment_daily() -> tuple[str, ...]:
    return (
        f"lex AS ({LEXICONS['bing']})",
        f"w AS ({_words('posts', 'created_at')})",
        "s AS (SELECT sentiment, created_at AS date, count(*) AS n FROM w JOIN lex USING (word) GROUP BY ALL)",
    )


def _daily() -> tuple[str, ...]:
    return (
        "d AS (SELECT created_at AS date, CAST(sum(favorite_count) AS BIGINT) AS f, "
        "CAST(sum(retweet_count) AS BIGINT) AS r, count(*) AS t FROM posts WHERE NOT is_retweet GROUP BY ALL)",
        "m AS (SELECT date, 'Daily Favorites' AS type, f AS value FROM d UNION ALL "
        "SELECT date, 'Daily Retweets', r FROM d UNION ALL SELECT date, 'Daily Tweets', t FROM d)",
    )


def _trend(source: str, series: str, value: str, days: int) -> str:
    return (
        f"round(avg({value}) OVER (PARTITION BY {series} ORDER BY date "
        f"RANGE BETWEEN INTERVAL {days} DAY PRECEDING AND INTERVAL {days} DAY FOLLOWING), 6) AS trend FROM {source}"
    )


def _local_trend(source: str, series: str, value: str, days: int, columns: str) -> str:
    # every pair of days within reach, its weight written out
    moments = ", ".join([f"sum(w * u ** {k}) AS s{k}" for k in range(5)] + [f"sum(w * u ** {k} * y) AS t{k}" for k in range(3)])
    return (
        f"SELECT {columns}, round(CASE count WHEN 1 THEN t0 / s0 WHEN 2 THEN (t0 * s2 - t1 * s1) / (s0 * s2 - s1 * s1) ELSE "
        "(t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / "
        "(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)) END, 6) AS trend "
        f"FROM (SELECT {series}, date, {value}, count(y) AS count, {moments} FROM (SELECT a.{series}, a.date, a.{value}, "
        f"CAST(b.{value} AS DOUBLE) AS y, (b.date - a.date) / {days + 1}.0::DOUBLE AS u, (1 - abs(u) ** 3) ** 3 AS w "
        f"FROM {source} a JOIN {source} b ON a.{series} = b.{series} AND abs(b.date - a.date) <= {days}) GROUP BY ALL)"
    )


def _top_posts_ngrams(posts: int, top: int, where: str) -> str:
    return _posts(
        METRICS_LONG.strip(),
        f"best AS (SELECT metric AS type, {_stripped()} AS text FROM long WHERE NOT is_retweet "
        f"QUALIFY rank() OVER (PARTITION BY metric ORDER BY value DESC) <= {posts})",
        f"g AS ({_ngrams('best', 2, 'type')})",
        f"c AS (SELECT type, ngram, count(*) AS n FROM g WHERE {where} GROUP BY ALL)",
        f"t AS ({_top('c', top, 'type')})",
        final=f"SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY type ORDER BY ngram) <= {top}",
    )


def _histogram(source: str, keys: str, bins: int = 30) -> str:
    return (
        f"SELECT {keys}, CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((x - lo) / (hi - lo) * {bins}) + 1, {bins}) END "
        f"AS INTEGER) AS bin, count(*) AS n FROM (SELECT {keys}, x, min(x) OVER (PARTITION BY {keys}) AS lo, "
        f"max(x) OVER (PARTITION BY {keys}) AS hi FROM (SELECT *, log10(value) AS x FROM {source} WHERE value > 0)) GROUP BY ALL"
    )


def _gaps(final: str) -> str:
    """Orders as posts, of which some have no account, no text or no date."""
    return (
        "WITH gaps AS (SELECT CAST(o_orderkey AS VARCHAR) AS status_id, "
        "CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS screen_name, "
        "CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority || ' best' [:o_orderkey % 6] END AS text, "
        "CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END AS created_at, "
        "CAST(floor(o_totalprice / 1000) AS BIGINT) AS favorite_count, CAST(o_orderkey % 11 AS BIGINT) AS retweet_count FROM orders) "
        f"SELECT * FROM ({final})"
    )


def _z(value: str) -> str:
    return f"(ln({value} + 1) - avg(ln({value} + 1)) OVER ()) / nullif(stddev_samp(ln({value} + 1)) OVER (), 0)"


def _topics(cells: str, k: int, seed: int) -> tuple[str, ...]:
    """Unrolled expectation maximisation; tables ``held`` (bucket, topic, d), ``totals``, ``beta``.

    An iteration that moves less than ``TOLERANCE`` is the last: the tables of later ones are empty.
    """
    topics = range(1, k + 1)

    def weight(topic: int, text: str) -> str:
        digest = f"md5('{seed}.{(topic - 1) // 8}|' || {text})"
        return f"(CAST('0x' || substr({digest}, {4 * ((topic - 1) % 8) + 1}, 4) AS BIGINT) + 1.0::DOUBLE)"

    def divided(weights: list[str], source: str) -> str:
        total = " + ".join(f"w{t}" for t in topics)
        shares = ", ".join(f"n * w{t} / ({total}) AS p{t}" for t in topics)
        named = ", ".join(f"{w} AS w{t}" for t, w in zip(topics, weights))
        return f"SELECT bucket, ngram, n, {shares} FROM (SELECT bucket, ngram, n, {named} FROM {source})"

    sums = ", ".join(f"sum(p{t}) AS p{t}" for t in topics)
    cell = "bucket || '|' || ngram"
    steps = [
        f"cells AS MATERIALIZED (SELECT * FROM ({cells}) WHERE bucket IS NOT NULL AND ngram IS NOT NULL)",
        "size AS MATERIALIZED (SELECT 0.1::DOUBLE * count(DISTINCT ngram) AS v FROM cells)",
        f"e0 AS MATERIALIZED ({divided([f'{weight(t, "bucket")} * {weight(t, cell)}' for t in topics], 'cells')})",
        f"h0 AS MATERIALIZED (SELECT bucket, {sums} FROM e0 GROUP BY bucket)",
        f"t0 AS MATERIALIZED (SELECT ngram, {sums} FROM e0 GROUP BY ngram)",
        "m0 AS MATERIALIZED (SELECT 1.0::DOUBLE AS moved)",
    ]
    for i in range(MOST_ITERATIONS):
        moved = " + ".join(f"abs(a.p{t} - b.p{t})" for t in topics)
        whole = " + ".join(f"a.p{t}" for t in topics)
        weights = [f"(t.p{t} + 0.1::DOUBLE) * (h.p{t} + {50 / k!r}::DOUBLE) / (k.p{t} + v)" for t in topics]
        steps += [
            f"k{i} AS MATERIALIZED (SELECT {sums} FROM h{i})",
            f"e{i + 1} AS MATERIALIZED ("
            + divided(weights, f"(SELECT bucket, ngram, n, t, h, k, v FROM cells JOIN t{i} t USING (ngram) JOIN h{i} h USING (bucket), k{i} k, size, m{i} m WHERE m.moved >= {TOLERANCE!r})")
            + ")",
            f"h{i + 1} AS MATERIALIZED (SELECT bucket, {sums} FROM e{i + 1} GROUP BY bucket)",
            f"t{i + 1} AS MATERIALIZED (SELECT ngram, {sums} FROM e{i + 1} GROUP BY ngram)",
            f"m{i + 1} AS MATERIALIZED (SELECT sum({moved}) / (2 * sum({whole})) AS moved FROM h{i + 1} a JOIN h{i} b USING (bucket))",
        ]
    last = [f"SELECT h.* FROM h{i} h, m{i} WHERE moved < {TOLERANCE!r}" for i in range(1, MOST_ITERATIONS + 1)]
    listed = [f"SELECT t.* FROM t{i} t, m{i} WHERE moved < {TOLERANCE!r}" for i in range(1, MOST_ITERATIONS + 1)]
    long = ", ".join(f"({t}, p{t})" for t in topics)
    return (
        *steps,
        f"held AS MATERIALIZED (SELECT bucket, topic, d FROM ({' UNION ALL '.join(last)}), LATERAL (VALUES {long}) x(topic, d))",
        "totals AS (SELECT topic, sum(d) AS s FROM held GROUP BY ALL)",
        f"beta AS (SELECT ngram AS term, topic, (p + 0.1::DOUBLE) / (s + v) AS beta, round(p, 6) AS expected "
        f"FROM (SELECT ngram, topic, p FROM ({' UNION ALL '.join(listed)}), LATERAL (VALUES {long}) x(topic, p)) JOIN totals USING (topic) CROSS JOIN size)",
    )


def _cells(n: int, division: str, where: str = "true") -> str:
    source = f"(SELECT {_bucket(division)} AS bucket, {_cleaned()} AS text FROM posts)"
    grams = _ngrams(source, n, "bucket")
    return f"SELECT bucket, ngram, count(*) AS n FROM ({grams}) WHERE {where} GROUP BY ALL"


_TOPIC = "CAST(topic AS INTEGER) AS topic"


def _gamma(k: int) -> str:
    prior = f"{50 / k!r}::DOUBLE"
    return (
        f"SELECT bucket AS document, {_TOPIC}, "
        f"round((d + {prior}) / (sum(d) OVER (PARTITION BY bucket) + {k} * {prior}), 6) AS gamma FROM held"
    )


def build() -> dict[str, str]:
    """SQL per query name."""
    month_model = _topics(_cells(2, "month"), 4, 0)
    biweek_model = _topics(_cells(1, "biweek", _no_stopword()), 3, 7)
    return {
        # sources and sinks
        "load_posts_csv": _posts(
            final=f"SELECT strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, {RAW} FROM marked"
        ),
        "write_posts_csv": _posts(
            final=f"SELECT {_day()} AS created_at, * EXCLUDE (created_at) REPLACE ({_cleaned()} AS text) "
            f"FROM (SELECT created_at, {RAW} FROM posts)"
        ),
        "user_timeline": _posts(
            final=f"SELECT screen_name, status_id, {_day()} AS created_at, text FROM posts "
            "WHERE screen_name = 'Customer#000001378' ORDER BY posts.created_at DESC, status_id LIMIT 3200"
        ),
        "load_lexicon": "SELECT lower(p_name) AS word, CAST(p_size AS VARCHAR) AS sentiment FROM part",
        "load_stopwords": "SELECT DISTINCT lower(c_mktsegment) AS word FROM customer WHERE c_mktsegment IS NOT NULL",
        # projections, filters, scalar functions
        "clean_text": _posts(
            final=f"SELECT status_id, {_cleaned()} AS text FROM (SELECT CAST(page_id AS VARCHAR) AS status_id, html AS text "
            "FROM pages UNION ALL SELECT status_id, text FROM marked)"
        ),
        "strip_links": _posts(final=f"SELECT status_id, {_stripped()} AS text FROM marked"),
        "normalise_posts": _posts(
            final=f"SELECT {_day()} AS created_at, * EXCLUDE (created_at) REPLACE ({_cleaned()} AS text) "
            f"FROM (SELECT created_at, {RAW} FROM marked)"
        ),
        "select_columns": _posts(
            final='SELECT status_id, favorite_count AS "FavoritesReceived", retweet_count AS "RetweetsReceived" FROM posts'
        ),
        "original_posts": _posts(final="SELECT status_id, is_retweet, favorite_count FROM posts WHERE NOT is_retweet"),
        "exclude_pattern": _ngram_counts(2, "NOT regexp_matches(ngram, '^th|[aeiou]n ')"),
        "contains_pattern": _ngram_counts(2, "regexp_matches(ngram, '^th|[aeiou]n ')"),
        "drop_stopword_ngrams": _ngram_counts(2, _no_stopword()),
        "drop_stopword_ngrams_substring": _ngram_counts(2, f"NOT regexp_matches(ngram, '{'|'.join(STOPWORDS)}')"),
        "exclude_exact": _posts(
            f"w AS ({_words('posts')})", final="SELECT word, count(*) AS n FROM w WHERE word <> 'the' GROUP BY word"
        ),
        "date_range_filter": _posts(
            final=f"SELECT status_id, {_day()} AS created_at FROM posts "
            "WHERE posts.created_at BETWEEN DATE '1996-02-01' AND DATE '1998-06-30'"
        ),
        "calendar_buckets": _posts(
            final="SELECT status_id, "
            + ", ".join(f"{_bucket(d)} AS {d}" for d in ("month", "biweek", "week", "day", "week_year"))
            + " FROM posts"
        ),
        "date_casts": f"SELECT event_id, {_day('ts')} AS day FROM events",
        "lower_text": _posts(final="SELECT status_id, lower(text) AS text FROM posts"),
        "label_contains": _posts(
            final="SELECT status_id, CASE WHEN regexp_matches(lower(text), 'the [aio]') THEN 'contains The [aio]' "
            "ELSE 'doesn''t contain The [aio]' END AS \"Word\" FROM posts"
        ),
        "label_metric": _posts(
            final="SELECT status_id, 'Favorites' AS metric, favorite_count AS value FROM posts UNION ALL "
            "SELECT status_id, 'Retweets', retweet_count FROM posts"
        ),
        "signed_mirror": _posts(
            f"lex AS ({LEXICONS['bing']})",
            f"w AS ({_words('posts')})",
            final="SELECT word, sentiment, CASE WHEN sentiment = 'negative' THEN -count(*) ELSE count(*) END AS n "
            "FROM w JOIN lex USING (word) GROUP BY word, sentiment",
        ),
        "normalise_handle": _posts(
            f"p AS ({_pieces('posts')})",
            final=f"SELECT {_handle()} AS handle, count(*) AS n FROM p GROUP BY ALL",
        ),
        "log_scores": _posts(
            final="SELECT status_id, round(ln(retweet_count + 1), 6) AS log_score, "
            "CASE WHEN retweet_count > 0 THEN round(log10(retweet_count), 6) END AS log_scale FROM posts"
        ),
        # tokenisation
        "tokenize_words": _posts(final=_words("posts", "status_id")),
        "tokenize_words_numbers": "SELECT CAST(o_orderkey AS VARCHAR) AS status_id, "
        f"unnest({_tokens(NUMBERED)}) AS word FROM orders",
        "tokenize_ngrams": _posts(final=_ngrams("posts", 2, "status_id")),
        "tokenize_ngrams_1": _ngram_counts(1),
        "tokenize_ngrams_3": _ngram_counts(3),
        "tokenize_ngrams_4": _ngram_counts(4),
        "tokenize_whitespace": _posts(final=_pieces("posts", "status_id")),
        "first_word": _posts(
            f"g AS ({_ngrams('posts', 2)})",
            final=r"SELECT regexp_extract(ngram, '^[\p{L}\p{N}]*') AS word, count(*) AS n FROM g GROUP BY ALL",
        ),
        "extract_mentions": _posts(
            f"p AS ({_pieces('marked', 'status_id')})",
            final=f"SELECT status_id, {_handle()} AS word FROM p WHERE p.word LIKE '%@%'",
        ),
        # joins
        "lexicon_join": _posts(
            f"lex AS ({LEXICONS['nrc']})",
            f"w AS ({_words('posts', 'status_id')})",
            final="SELECT status_id, word, sentiment FROM w JOIN lex USING (word)",
        ),
        "lexicon_join_large": _posts(
            f"w AS ({_words('posts', 'status_id')})",
            final="SELECT status_id, sentiment, count(*) AS n FROM (SELECT status_id, unnest([substr(word, 1, 1), 'any']) AS sentiment FROM w) GROUP BY ALL",
        ),
        "join_back_text": _posts(
            f"lex AS ({LEXICONS['bing']})",
            f"w AS ({_words('posts', 'status_id')})",
            "c AS (SELECT status_id, sentiment, count(*) AS n FROM w JOIN lex USING (word) GROUP BY ALL)",
            final="SELECT status_id, text, sentiment, n FROM c JOIN posts USING (status_id)",
        ),
        "ngram_context": _posts(
            f"lex AS ({LEXICONS['bing']})",
            f"g AS ({_ngrams('posts', 2, 'status_id')})",
            "w AS (SELECT status_id, ngram, unnest(string_split(ngram, ' ')) AS word FROM g "
            "WHERE list_has_any(string_split(ngram, ' '), (SELECT list(word) FROM lex)))",
            final="SELECT status_id, ngram, word, sentiment FROM w JOIN lex USING (word)",
        ),
        # aggregations and reshape
        "count_by": _posts(final="SELECT screen_name, is_retweet, count(*) AS n FROM posts GROUP BY ALL"),
        "metric_summary": "SELECT l_returnflag, round(min(l_quantity), 6) AS min, round(median(l_quantity), 6) AS median, "
        "round(avg(l_quantity), 6) AS mean, round(max(l_quantity), 6) AS max, round(stddev_samp(l_quantity), 6) AS sd, "
        'count(*) AS "TotalTweets" FROM lineitem GROUP BY l_returnflag',
        "daily_sums": _posts(
            final=f"SELECT {_day()} AS date, CAST(sum(favorite_count) AS BIGINT) AS \"Daily Favorites\", "
            'CAST(sum(retweet_count) AS BIGINT) AS "Daily Retweets", count(*) AS "Daily Tweets" FROM posts GROUP BY 1'
        ),
        "group_median": _posts(
            METRICS_LONG.strip(),
            final="SELECT metric, is_retweet, status_id, value, "
            "CAST(median(value) OVER (PARTITION BY metric, is_retweet) AS DOUBLE) AS median FROM long",
        ),
        "unpivot_metrics": _posts(METRICS_LONG.strip(), final="SELECT status_id, metric AS type, value FROM long"),
        "date_bounds": _posts(final=f"SELECT {_day('min(created_at)')} AS first, {_day('max(created_at)')} AS last FROM posts"),
        "tf_idf": _posts(
            f"w AS ({_words('posts', 'year(created_at) AS year')})",
            "c AS (SELECT CAST(year AS INTEGER) AS year, word, count(*) AS n FROM w GROUP BY ALL)",
            "x AS (SELECT *, n / sum(n) OVER (PARTITION BY year) AS tf, "
            "ln((SELECT count(DISTINCT year) FROM c) / count(*) OVER (PARTITION BY word)) AS idf FROM c)",
            final="SELECT year, word, n, round(tf, 6) AS tf, round(idf, 6) AS idf, round(tf * idf, 6) AS tf_idf FROM x",
        ),
        "log_histogram": _posts(METRICS_LONG.strip(), final=_histogram("long", "metric, is_retweet")),
        "zscore_percentile": _posts(
            final=" UNION ALL ".join(
                f"SELECT status_id, {metric} AS value, round({_z(metric)}, 6) AS z, '{metric}' AS metric FROM posts"
                for metric in ("favorite_count", "retweet_count")
            )
        ),
        "zscore_percentile_values": _posts(
            final="SELECT status_id, metric, value, round(z, 6) AS z, round(50 + 100 * exp(-z * z / 2) / sqrt(2 * pi()) "
            # the normal integral as a power series: z^(2i+1) over the odd factorial of 2i+1
            "* list_sum(list_transform(range(0, 120), lambda i: pow(z, 2 * i + 1) * sqrt(pi()) / (pow(2, i + 1) * gamma(i + 1.5)))), 6) "
            "AS percentile FROM ("
            + " UNION ALL ".join(
                f"SELECT status_id, '{metric}' AS metric, {metric} AS value, {_z(metric)} AS z FROM posts"
                for metric in ("favorite_count", "retweet_count")
            )
            + ")"
        ),
        "label_high_low": _posts(
            f"z AS (SELECT status_id, retweet_count, {_z('retweet_count')} AS z FROM posts)",
            final="SELECT status_id, retweet_count, "
            f"CASE WHEN z > 0.6744897501960817 THEN '{HIGH}' ELSE '{LOW}' END AS comparison FROM z WHERE z IS NOT NULL",
        ),
        # ranking
        "top_n": _posts(final="SELECT status_id, retweet_count FROM posts QUALIFY rank() OVER (ORDER BY retweet_count DESC) <= 25"),
        "top_n_by_group": _posts(
            final="SELECT status_id, screen_name, retweet_count FROM posts "
            "QUALIFY rank() OVER (PARTITION BY screen_name ORDER BY retweet_count DESC) <= 1"
        ),
        "top_k_exact": _posts(
            final="SELECT status_id, is_retweet, retweet_count FROM posts "
            "QUALIFY row_number() OVER (PARTITION BY is_retweet ORDER BY retweet_count DESC, status_id) <= 25"
        ),
        "capped_top": _posts(
            f"g AS ({_ngrams('posts', 2, 'is_retweet')})",
            "c AS (SELECT is_retweet, ngram, count(*) AS n FROM g GROUP BY ALL)",
            f"t AS ({_top('c', 25, 'is_retweet')})",
            final="SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY is_retweet ORDER BY ngram) <= 25",
        ),
        "sort_rows": _posts(
            final="SELECT status_id, favorite_count, retweet_count FROM posts ORDER BY favorite_count DESC, retweet_count, status_id"
        ),
        "preview": _posts(
            final=f"SELECT status_id, {_day()} AS created_at, text FROM posts ORDER BY posts.created_at, status_id LIMIT 6"
        ),
        "rank_within": f"SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY n, word) AS ord "
        f"FROM ({_sentiment_words('nrc', 5, '')})",
        "daily_trend": "WITH d AS (SELECT event_type AS series, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY ALL) "
        f"SELECT series, {_day('date')} AS date, n, {_trend('d', 'series', 'n', 3)}",
        "daily_trend_linear": "WITH d AS (SELECT event_type AS series, CAST(ts AS DATE) AS date, CAST(count(*) AS DOUBLE) AS n FROM events "
        "GROUP BY ALL), x AS (SELECT *, CAST(date - DATE '1970-01-01' AS DOUBLE) AS day FROM d), "
        "w AS (SELECT *, avg(n) OVER near AS mean, avg(day) OVER near AS middle, regr_slope(n, day) OVER near AS slope FROM x "
        "WINDOW near AS (PARTITION BY series ORDER BY day RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)) "
        f"SELECT series, {_day('date')} AS date, CAST(n AS BIGINT) AS n, "
        "round(coalesce(mean + CASE WHEN isnan(slope) THEN NULL ELSE slope END * (day - middle), mean), 6) AS trend FROM w",
        "daily_trend_local": "WITH d AS (SELECT event_type AS series, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY ALL) "
        + _local_trend("d", "series", "n", 3, f"series, {_day('date')} AS date, n"),
        # rows with missing keys, texts and dates, and posts late on the last day
        "date_range_filter_times": f"SELECT event_id, {_day('ts')} AS created_at FROM events "
        "WHERE CAST(ts AS DATE) BETWEEN (SELECT min(CAST(ts AS DATE)) + 1 FROM events) AND (SELECT min(CAST(ts AS DATE)) + 2 FROM events)",
        "calendar_buckets_missing": _gaps(
            "SELECT status_id, " + ", ".join(f"{_bucket(d)} AS {d}" for d in ("month", "biweek", "week", "day", "week_year")) + " FROM gaps"
        ),
        "top_n_by_group_missing": _gaps(
            "SELECT status_id, screen_name, favorite_count FROM gaps "
            "QUALIFY rank() OVER (PARTITION BY screen_name ORDER BY favorite_count DESC) <= 3"
        ),
        "metric_summary_missing": _gaps(
            "SELECT screen_name, CAST(min(favorite_count) AS BIGINT) AS min, round(median(favorite_count), 6) AS median, "
            "round(avg(favorite_count), 6) AS mean, CAST(max(favorite_count) AS BIGINT) AS max, "
            'round(stddev_samp(favorite_count), 6) AS sd, count(*) AS "TotalTweets" FROM gaps GROUP BY screen_name'
        ),
        "group_median_missing": _gaps(
            "SELECT status_id, screen_name, favorite_count, CAST(median(favorite_count) OVER (PARTITION BY screen_name) AS DOUBLE) AS median FROM gaps"
        ),
        "log_histogram_missing": _gaps(
            _histogram("(SELECT screen_name, favorite_count AS value FROM gaps)", "screen_name")
        ),
        "tf_idf_missing": _gaps(
            "WITH c AS (SELECT screen_name, month(created_at) AS term, count(*) AS n FROM gaps GROUP BY ALL), "
            "x AS (SELECT *, n / sum(n) OVER (PARTITION BY screen_name) AS tf, "
            "ln((SELECT count(*) FROM (SELECT DISTINCT screen_name FROM c)) / count(*) OVER (PARTITION BY term)) AS idf FROM c) "
            "SELECT screen_name, CAST(term AS INTEGER) AS term, n, round(tf, 6) AS tf, round(idf, 6) AS idf, round(tf * idf, 6) AS tf_idf FROM x"
        ),
        "metric_distribution_missing": _gaps(
            "WITH x AS (SELECT 'Favorites' AS metric, text, favorite_count AS value FROM gaps UNION ALL SELECT 'Retweets', text, retweet_count FROM gaps), "
            "y AS (SELECT metric, CASE WHEN contains(lower(text), 'best') THEN 'contains best' WHEN text IS NOT NULL "
            "THEN 'doesn''t contain best' END AS \"Word\", value FROM x), "
            f"h AS ({_histogram('y', 'metric, \"Word\"')}), "
            'm AS (SELECT metric, "Word", CAST(round(median(value), 6) AS DOUBLE) AS median FROM y GROUP BY ALL) '
            'SELECT h.metric, h."Word", bin, n, median FROM h JOIN m ON h.metric = m.metric AND h."Word" IS NOT DISTINCT FROM m."Word"'
        ),
        "load_posts_csv_marks": "SELECT CAST(o_orderkey AS VARCHAR) AS status_id, CASE CAST(o_orderkey AS BIGINT) % 4 WHEN 0 THEN NULL WHEN 1 THEN '' "
        "WHEN 2 THEN chr(92) || 'N' ELSE chr(92) || chr(92) || 'N' END AS text FROM orders",
        "drop_stopword_ngrams_table": _posts(
            f"g AS ({_ngrams('posts', 2)})",
            "c AS MATERIALIZED (SELECT ngram, count(*) AS n FROM g GROUP BY ngram)",
            "s AS (SELECT DISTINCT lower(p) AS word FROM (SELECT unnest(string_split(p_name, ' ')) AS p FROM part "
            "UNION ALL SELECT unnest(string_split(html, ' ')) FROM pages))",
            "h AS (SELECT DISTINCT ngram FROM (SELECT ngram, unnest(string_split(ngram, ' ')) AS word FROM c) JOIN s USING (word))",
            final="SELECT ngram, n FROM c ANTI JOIN h USING (ngram)",
        ),
        "drop_stopword_ngrams_substring_table": _posts(
            f"g AS ({_ngrams('posts', 2)})",
            "c AS MATERIALIZED (SELECT ngram, count(*) AS n FROM g GROUP BY ngram)",
            "p AS (SELECT DISTINCT substr(w, 1, length(w) - 2) AS word FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE length(w) > 3)",
            "k AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS word FROM orders)",
            # a key is digits, so only n-grams with a digit can hold one
            "h AS (SELECT DISTINCT ngram FROM c JOIN p ON contains(ngram, word) UNION SELECT DISTINCT ngram FROM "
            "(SELECT ngram FROM c WHERE regexp_matches(ngram, '[0-9]')) JOIN k ON contains(ngram, word))",
            final="SELECT ngram, n FROM c ANTI JOIN h USING (ngram)",
        ),
        "top_n_deep": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY rank() OVER (ORDER BY l_extendedprice DESC) <= 25000",
        "load_posts_csv_mixed": _posts(
            final=f"SELECT strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, {RAW} FROM marked"
        ),
        "load_posts_csv_rejected": _posts(
            "k AS (SELECT *, CAST(status_id AS BIGINT) AS id FROM posts)",
            final="SELECT status_id, CASE id % 2 WHEN 1 THEN 'other' ELSE 'own' END AS maker, "
            "concat_ws('; ', CASE id % 7 WHEN 0 THEN 'created_at is no timestamp' END, "
            "CASE id % 5 WHEN 0 THEN 'favorite_count is no bigint' END) AS reason FROM k WHERE id % 7 = 0 OR id % 5 = 0",
        ),
        # set operations
        "union_series": _posts(
            final=f"SELECT CASE WHEN is_retweet THEN 'retweets' ELSE 'originals' END AS series, {_day()} AS date, count(*) AS n "
            f"FROM posts GROUP BY ALL UNION ALL SELECT 'Tweets/Day', {_day()}, count(*) FROM posts WHERE NOT is_retweet GROUP BY 2"
        ),
        # topic modelling
        "document_terms": _posts(
            f"w AS ({_words('posts', _bucket('biweek') + ' AS bucket', out='ngram')})",
            final="SELECT bucket, ngram, count(*) AS n FROM w GROUP BY ALL",
        ),
        "fit_topics": _posts(
            *month_model,
            final="SELECT bucket, "
            + ", ".join(f"round(sum(CASE WHEN topic = {t} THEN d END), 6) AS topic{t}" for t in range(1, 5))
            + " FROM held GROUP BY bucket",
        ),
        "topic_terms": _posts(
            *month_model,
            f"t AS ({_top('beta', 25, 'topic', 'expected')})",
            final=f"SELECT {_TOPIC}, term, round(beta, 6) AS beta FROM t",
        ),
        "topic_documents": _posts(*month_model, final=_gamma(4)),
        "topic_likelihood": _posts(
            *month_model,
            f"gamma AS (SELECT bucket, topic, (d + {50 / 4!r}::DOUBLE) / (sum(d) OVER (PARTITION BY bucket) + {50.0!r}::DOUBLE) AS g FROM held)",
            "chances AS (SELECT bucket, ngram, n, sum(g * beta) AS chance FROM cells JOIN gamma USING (bucket) "
            "JOIN beta ON term = ngram AND beta.topic = gamma.topic GROUP BY ALL)",
            final="SELECT bucket AS document, CAST(sum(n) AS BIGINT) AS n, round(sum(n * ln(chance)) / sum(n), 6) AS per_word "
            "FROM chances GROUP BY bucket",
        ),
        "update_topics": _posts(
            f"c AS ({_cells(1, 'biweek')})", final="SELECT ngram, CAST(sum(n) AS BIGINT) AS n FROM c "
            "WHERE bucket IS NOT NULL AND ngram IS NOT NULL GROUP BY ngram"
        ),
        # the complete analytics
        "fit_topics_converged": _posts(
            f"c AS ({_cells(1, 'biweek')})", final="SELECT bucket, CAST(sum(n) AS BIGINT) AS n, true AS converged FROM c "
            "WHERE bucket IS NOT NULL GROUP BY bucket"
        ),
        "post_summary": _posts(
            METRICS_LONG.strip(),
            final="SELECT CASE metric WHEN 'favorite_count' THEN 'FavoritesReceived' ELSE 'RetweetsReceived' END AS key, "
            "min(value) AS min, CAST(round(median(value), 6) AS DOUBLE) AS median, round(avg(value), 6) AS mean, "
            'max(value) AS max, round(stddev_samp(value), 6) AS sd, count(*) AS "TotalTweets" '
            "FROM long WHERE NOT is_retweet GROUP BY metric",
        ),
        "ngram_top": _posts(
            f"g AS ({_ngrams('posts')})", "c AS (SELECT ngram, count(*) AS n FROM g GROUP BY ngram)", final=_top("c", 5)
        ),
        "ngram_top_filtered": _posts(
            f"g AS ({_ngrams('posts', 3)})",
            "c AS (SELECT ngram, count(*) AS n FROM g WHERE NOT regexp_matches(ngram, 'ing') "
            f"AND regexp_matches(ngram, 'er') AND {_no_stopword()} GROUP BY ngram)",
            final=_top("c", 25),
        ),
        "ngram_negation": _posts(
            f"g AS ({_ngrams('posts', text=_stripped())})",
            r"c AS (SELECT ngram, count(*) AS n FROM g WHERE starts_with(ngram, 'no') "
            r"AND regexp_extract(ngram, '^[\p{L}\p{N}]*') = 'no' GROUP BY ngram)",
            final=_top("c", 5),
        ),
        "sentiment_words": _sentiment_words("bing", 5, "with"),
        "sentiment_words_nrc": _sentiment_words("nrc", 2, ""),
        "sentiment_words_afinn": _sentiment_words("afinn", 5, ""),
        "sentiment_daily": _posts(*_sentiment_daily(), final=f"SELECT sentiment, {_day('date')} AS date, n FROM s"),
        "sentiment_trend": _posts(
            *_sentiment_daily(),
            "u AS (SELECT sentiment AS series, date, n FROM s UNION ALL SELECT 'Tweets/Day', created_at, count(*) "
            "FROM posts WHERE NOT is_retweet GROUP BY created_at)",
            final=f"SELECT series, {_day('date')} AS date, n, {_trend('u', 'series', 'n', 7)}",
        ),
        "sentiment_trend_local": _posts(
            *_sentiment_daily(),
            "u AS (SELECT sentiment AS series, CAST(date AS DATE) AS date, n FROM s UNION ALL SELECT 'Tweets/Day', CAST(created_at AS DATE), "
            "count(*) FROM posts WHERE NOT is_retweet GROUP BY 2)",
            final=_local_trend("u", "series", "n", 14, f"series, {_day('date')} AS date, n"),
        ),
        "ngram_sentiment": _posts(
            f"lex AS ({LEXICONS['bing']})",
            f"g AS ({_ngrams('posts', text=_stripped())})",
            "w AS (SELECT ngram, unnest(string_split(ngram, ' ')) AS word FROM g "
            "WHERE list_has_any(string_split(ngram, ' '), (SELECT list(word) FROM lex)) AND NOT regexp_matches(ngram, 'ing'))",
            "c AS (SELECT sentiment, ngram, count(*) AS n FROM w JOIN lex USING (word) GROUP BY ALL)",
            f"t AS ({_top('c', 5, 'sentiment')})",
            final="SELECT sentiment, ngram, CASE WHEN sentiment = 'negative' THEN -n ELSE n END AS n FROM t",
        ),
        "sentiment_posts": _posts(
            f"lex AS ({LEXICONS['bing']})",
            f"w AS ({_words('posts', 'status_id, is_retweet')})",
            "c AS (SELECT status_id, sentiment, count(*) AS n FROM w JOIN lex USING (word) WHERE NOT is_retweet GROUP BY ALL)",
            "t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY sentiment ORDER BY n DESC, status_id) <= 5)",
            final=f"SELECT {_day()} AS created_at, text, sentiment, n FROM t JOIN posts USING (status_id)",
        ),
        "metric_daily": _posts(*_daily(), final=f"SELECT {_day('date')} AS date, type, value FROM m"),
        "metric_trend": _posts(
            *_daily(), final=f"SELECT {_day('date')} AS date, type, value, {_trend('m', 'type', 'value', 7)}"
        ),
        "metric_trend_local": _posts(
            *_daily(),
            "l AS (SELECT * REPLACE (CAST(date AS DATE) AS date) FROM m)",
            final=_local_trend("l", "type", "value", 14, f"{_day('date')} AS date, type, value"),
        ),
        "top_posts": _posts(
            final=f"SELECT text, {_day()} AS date, 'retweet_count' AS type, retweet_count AS value FROM posts "
            "WHERE NOT is_retweet QUALIFY rank() OVER (ORDER BY retweet_count DESC) <= 5"
        ),
        "top_posts_ngrams": _top_posts_ngrams(100, 5, "NOT regexp_matches(ngram, 'ing')"),
        "top_posts_ngrams_stopwords": _top_posts_ngrams(250, 10, _no_stopword()),
        "mention_top": _posts(
            f"p AS ({_pieces('(SELECT * FROM marked WHERE NOT is_retweet)', text=_stripped())})",
            f"h AS (SELECT {_handle()} AS word FROM p WHERE p.word LIKE '%@%')",
            "c AS (SELECT word, count(*) AS n FROM h WHERE word NOT IN ('', 'srch') GROUP BY word)",
            final=_top("c", 5),
        ),
        "metric_distribution": _posts(
            METRICS_LONG.strip(),
            "x AS (SELECT CASE metric WHEN 'favorite_count' THEN 'Favorites' ELSE 'Retweets' END AS metric, "
            "CASE WHEN regexp_matches(lower(text), 'best') THEN 'contains Best' ELSE 'doesn''t contain Best' END AS \"Word\", "
            "value FROM long WHERE NOT is_retweet)",
            f"h AS ({_histogram('x', 'metric, \"Word\"')})",
            'm AS (SELECT metric, "Word", CAST(round(median(value), 6) AS DOUBLE) AS median FROM x GROUP BY ALL)',
            final='SELECT metric, "Word", bin, n, median FROM h JOIN m USING (metric, "Word")',
        ),
        "high_low_terms": _posts(
            f"z AS (SELECT text, {_z('favorite_count')} AS z FROM posts WHERE NOT is_retweet)",
            f"l AS (SELECT text, CASE WHEN z > 0 THEN '{HIGH}' ELSE '{LOW}' END AS comparison FROM z WHERE z IS NOT NULL)",
            f"g AS ({_ngrams('l', 2, 'comparison')})",
            "c AS (SELECT comparison, ngram, count(*) AS n FROM g GROUP BY ALL)",
            "x AS (SELECT *, n / sum(n) OVER (PARTITION BY comparison) AS tf, "
            "ln((SELECT count(DISTINCT comparison) FROM c) / count(*) OVER (PARTITION BY ngram)) AS idf FROM c)",
            f"t AS ({_top('x', 5, 'comparison', 'tf * idf')})",
            final="SELECT comparison, ngram, n, round(tf, 6) AS tf, round(idf, 6) AS idf, "
            f"round(CASE WHEN comparison = '{LOW}' THEN -tf * idf ELSE tf * idf END, 6) AS tf_idf FROM t",
        ),
        "topic_buckets": _posts(
            "r AS (SELECT * FROM posts WHERE created_at BETWEEN DATE '1996-01-01' AND DATE '1999-12-31')",
            final=_cells(2, "week", f"NOT regexp_matches(ngram, 'ing') AND {_no_stopword()}").replace("FROM posts", "FROM r"),
        ),
        "topic_terms_job": _posts(
            *biweek_model,
            f"t AS ({_top('beta', 5, 'topic', 'expected')})",
            final=f"SELECT {_TOPIC}, term, round(beta, 6) AS beta FROM t",
        ),
        "topic_documents_job": _posts(*biweek_model, final=_gamma(3)),
        "post_preview": _posts(
            final=f"SELECT {_day()} AS created_at, text FROM posts ORDER BY posts.created_at, status_id LIMIT 6"
        ),
        "raw_table": _posts(final=f"SELECT {_day()} AS created_at, {RAW} FROM posts ORDER BY 1, status_id"),
    }
