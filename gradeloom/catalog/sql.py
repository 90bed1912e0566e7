"""Common table expressions shared by the SQL counterparts (DuckDB dialect)."""

from gradeloom.functions.constants import CONTENT_TAGS, CONTRACTIONS, STOP_WORDS
from gradeloom.functions.text import BLANK, WORD


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


SCORED = """
scored AS (
  SELECT doc_id, lang,
    CAST(ntile(6) OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS BIGINT) AS score
  FROM documents)"""

RATINGS = """
ratings AS (
  SELECT doc_id AS essay_id, lang AS prompt_name, score,
    least(6, greatest(1, score + doc_id % 3 - 1)) AS predicted
  FROM scored)"""


def word_count(text: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '[^{BLANK}]+')) AS BIGINT)"


ESSAYS = f"""
essays AS (
  SELECT d.doc_id AS essay_id, d.doc_id AS row_id, s.score,
    CASE WHEN d.doc_id % 97 = 11 THEN NULL ELSE text END AS full_text,
    CASE WHEN d.doc_id % 13 = 4 THEN NULL ELSE {word_count('text')} END AS essay_word_count,
    CASE WHEN d.doc_id % 17 = 5 OR d.doc_id % 101 IN (40, 41) THEN NULL
         ELSE concat(d.lang, '_', source) END AS assignment,
    CASE WHEN d.doc_id % 31 = 8 OR d.doc_id % 101 = 41 THEN NULL ELSE d.lang END AS prompt_name,
    CASE WHEN d.doc_id % 23 IN (7, 8) THEN NULL ELSE 6 + d.doc_id % 7 END AS grade_level,
    CASE WHEN d.doc_id % 19 = 3 THEN NULL WHEN d.doc_id % 2 = 0 THEN 'Economically disadvantaged'
         ELSE 'Other' END AS economically_disadvantaged,
    CASE WHEN d.doc_id % 29 = 6 THEN NULL
         WHEN d.doc_id % 5 = 0 THEN 'Identified as having disability'
         ELSE 'Not identified as having disability' END AS student_disability_status,
    CASE WHEN d.doc_id % 37 = 9 THEN NULL WHEN d.doc_id % 4 = 0 THEN 'Yes' ELSE 'No' END
      AS ell_status,
    CASE WHEN d.doc_id % 41 = 2 THEN NULL ELSE concat('group', CAST(d.doc_id % 6 AS VARCHAR)) END
      AS race_ethnicity,
    CASE WHEN d.doc_id % 43 = 1 THEN NULL WHEN d.doc_id % 3 = 0 THEN 'M' ELSE 'F' END AS gender
  FROM documents d JOIN scored s USING (doc_id))"""

ESSAY = with_(SCORED, ESSAYS)


def normalised(text: str) -> str:
    return f"regexp_replace(lower({text}), '[^{WORD}{BLANK}]+', '', 'g')"


def contracted(text: str) -> str:
    for head, tail in CONTRACTIONS:
        text = f"regexp_replace({text}, '\\b{head}{tail}\\b', '{head} {tail}', 'g')"
    return text


def words(text: str) -> str:
    pieces = f"string_split_regex({contracted(normalised(text))}, '[{BLANK}]+')"
    return f"list_filter({pieces}, lambda x: x <> '')"


def content_tokens(text: str) -> str:
    return f"list_filter({words(text)}, lambda x: x NOT IN ({quoted(STOP_WORDS)}))"


def tokens(source: str = "documents", doc: str = "doc_id", text: str = "text",
           group: str = "lang", order: str = "doc_id") -> str:
    return f"""
tokens AS (
  SELECT {doc} AS doc_key, {group} AS group_key, {order} AS row_key,
    {content_tokens(text)} AS tokens
  FROM {source})"""


def grams(source: str = "tokens", name: str = "grams") -> str:
    return f"""
{name} AS (
  SELECT doc_key, group_key, row_key, pos, tokens[pos + 1] || ' ' || tokens[pos + 2] AS gram
  FROM (SELECT *, unnest(range(0, len(tokens) - 1)) AS pos FROM {source}))"""


def top(source: str = "grams", n: int = 1000, prefix: str = "") -> str:
    return f"""
{prefix}counts AS (
  SELECT group_key, gram, count(*) AS occurrences, min(row_key) AS first_row,
    arg_min(pos, row_key * 10000000 + pos) AS first_pos
  FROM {source} GROUP BY ALL),
{prefix}top AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (
      PARTITION BY group_key ORDER BY occurrences DESC, first_row, first_pos) AS rank
    FROM {prefix}counts)
  WHERE rank <= {n})"""


def matched(prefix: str = "", source: str = "grams", docs: str = "tokens") -> str:
    return f"""
{prefix}sizes AS (SELECT group_key, count(*) AS list_size FROM {prefix}top GROUP BY ALL),
{prefix}matched AS (
  SELECT t.doc_key, any_value(t.group_key) AS group_key,
    count(p.gram) AS hits, count(DISTINCT p.gram) AS overlap,
    count(DISTINCT g.gram) AS own_grams,
    coalesce(any_value(s.list_size), 0) AS list_size
  FROM {docs} t
  LEFT JOIN {source} g ON g.doc_key = t.doc_key
  LEFT JOIN {prefix}top p ON p.group_key = g.group_key AND p.gram = g.gram
  LEFT JOIN {prefix}sizes s ON s.group_key = t.group_key
  GROUP BY t.doc_key)"""


TAGGED = """
tagged AS (
  SELECT token, (['NN', 'IN', 'DT', 'JJ', 'CC', 'VB'])[
      (length(token) * 2 + CASE WHEN doc_key % 3 = 0 THEN 1 ELSE 0 END) % 6 + 1] AS tag
  FROM (SELECT doc_key, unnest(tokens) AS token FROM tokens)),
lexicon AS (
  SELECT token, tag, uses FROM (
    SELECT token, tag, count(*) AS uses,
      row_number() OVER (PARTITION BY token ORDER BY count(*) DESC, tag) AS r
    FROM tagged GROUP BY token, tag)
  WHERE r = 1)"""

KEPT_TAGS = quoted(CONTENT_TAGS)

CONTENT = f"""
content AS (
  SELECT t.doc_key, any_value(t.group_key) AS group_key, any_value(t.row_key) AS row_key,
    coalesce(list(x.token ORDER BY x.pos) FILTER (WHERE l.token IS NOT NULL), []) AS tokens
  FROM tokens t
  LEFT JOIN (SELECT doc_key, unnest(tokens) AS token,
               generate_subscripts(tokens, 1) AS pos FROM tokens) x ON x.doc_key = t.doc_key
  LEFT JOIN (SELECT token FROM lexicon WHERE tag IN ({KEPT_TAGS})) l ON l.token = x.token
  GROUP BY t.doc_key)"""

KEPT = f"""
kept AS (
  SELECT * REPLACE (coalesce(essay_word_count, {word_count('full_text')})
                    AS essay_word_count)
  FROM essays WHERE full_text IS NOT NULL)"""


def placed(source: str, columns, name: str) -> str:
    sides = ",\n    ".join(
        f"last_value({c} IGNORE NULLS) OVER up AS above_{c}, "
        f"first_value({c} IGNORE NULLS) OVER down AS below_{c}" for c in columns)
    return f"""
{name} AS (
  SELECT *, {sides}
  FROM {source}
  WINDOW up AS (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         down AS (ORDER BY row_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""


FILLED_ONCE = """
filled_once AS (
  SELECT * EXCLUDE (above_assignment, below_assignment, above_prompt_name, below_prompt_name,
                    above_grade_level, below_grade_level)
    REPLACE (
      CASE WHEN assignment IS NOT NULL THEN assignment
           WHEN coalesce(above_assignment = below_assignment, false) THEN above_assignment
           WHEN prompt_name IS NULL THEN above_assignment
           WHEN prompt_name = below_prompt_name THEN below_assignment
           ELSE above_assignment END AS assignment,
      CASE WHEN assignment IS NULL AND prompt_name IS NULL
                AND NOT coalesce(above_assignment = below_assignment, false)
           THEN above_prompt_name ELSE prompt_name END AS prompt_name,
      coalesce(grade_level, above_grade_level) AS grade_level)
  FROM placed_once)"""

FILLED_TWICE = """
filled_twice AS (
  SELECT * EXCLUDE (above_prompt_name, below_prompt_name)
    REPLACE (coalesce(prompt_name, CASE WHEN above_prompt_name = below_prompt_name
                                        THEN above_prompt_name END) AS prompt_name)
  FROM placed_twice)"""

NEIGHBOUR_FILL = ",\n".join(p.strip() for p in (
    placed("kept", ["assignment", "prompt_name", "grade_level"], "placed_once"), FILLED_ONCE,
    placed("filled_once", ["prompt_name"], "placed_twice"), FILLED_TWICE))


def number(salt: str) -> str:
    return f"('0x' || substr(md5(concat(essay_id, '|{salt}')), 1, 8))::UBIGINT::BIGINT"


def coin(column: str, first: str, second: str) -> str:
    return (f"coalesce({column}, CASE WHEN {number(column)} % 2 = 0 "
            f"THEN '{first}' ELSE '{second}' END)")


def observed(source: str, name: str) -> str:
    return f"""
options AS (SELECT list(DISTINCT race_ethnicity ORDER BY race_ethnicity) AS o FROM {source}
            WHERE race_ethnicity IS NOT NULL),
{name} AS (
  SELECT * EXCLUDE (o) REPLACE (
    coalesce(race_ethnicity, o[{number('race_ethnicity')} % len(o) + 1]) AS race_ethnicity)
  FROM {source}, options)"""


def coins(source: str, name: str) -> str:
    from gradeloom.functions.constants import COIN_FILLS
    fills = ",\n    ".join(f"{coin(c, a, b)} AS {c}" for c, (a, b) in COIN_FILLS.items())
    return f"""
{name} AS (SELECT * REPLACE ({fills}) FROM {source})"""


ESSAY_COLUMNS = [
    "essay_id", "row_id", "score", "full_text", "essay_word_count", "assignment", "prompt_name",
    "grade_level", "economically_disadvantaged", "student_disability_status", "ell_status",
    "race_ethnicity", "gender"]

FILLED = ",\n".join(p.strip() for p in (
    SCORED, ESSAYS, KEPT, NEIGHBOUR_FILL, coins("filled_twice", "coined"),
    observed("coined", "observed"),
    "filled AS (SELECT * FROM observed WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in ESSAY_COLUMNS) + ")"))


def split(source: str, seed: int = 42, share: str = "0.2") -> str:
    return f"""
strata AS (
  SELECT prompt_name, score, count(*) AS n, sum(count(*)) OVER (PARTITION BY prompt_name) AS total
  FROM {source} GROUP BY prompt_name, score),
shares AS (
  SELECT *, CAST(ceil(CAST({share} AS DOUBLE) * total) AS BIGINT) AS n_test FROM strata),
bases AS (
  SELECT *, (n_test * n) // total AS base, (n_test * n) % total AS left_over FROM shares),
quotas AS (
  SELECT prompt_name, score, base + CASE WHEN
      row_number() OVER (PARTITION BY prompt_name ORDER BY left_over DESC, score)
      <= n_test - sum(base) OVER (PARTITION BY prompt_name) THEN 1 ELSE 0 END AS quota
  FROM bases),
split AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.prompt_name, s.score
      ORDER BY md5(concat(s.essay_id, '|{seed}')), s.essay_id) <= q.quota AS is_test
  FROM {source} s JOIN quotas q ON q.prompt_name = s.prompt_name AND q.score = s.score)"""


WEIGHTS = """
weights AS (
  SELECT prompt_name, score, count(*) AS n,
    exp(-count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY prompt_name)) AS weight
  FROM split WHERE NOT is_test GROUP BY prompt_name, score)"""
