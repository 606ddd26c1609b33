"""Text queries over documents, conversations, responses and problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arithmetic as ar
from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import checks, metrics
from ..session import scratch_path
from ..sources.datasets import load_problems, read_metadata, write_metadata
from .fixtures import cte, table, view
from .registry import add

# --- SQL spellings of Unicode word boundaries and whitespace --------------------------------

_L, _R = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"
_SPACE = r"\s\x0b\x{85}\pZ"


def _word(words, text: str = "low") -> str:
    pattern = words if isinstance(words, str) else "|".join(words)
    return f"regexp_matches({text}, '{_L}({pattern}){_R}')"


# letters outside ASCII become 'a' so that the engine's ASCII boundaries agree with Unicode ones
_ASCII = r"regexp_replace(text, '[\p{L}]', 'a', 'g')"
_QT = f"""CASE WHEN {_word("how many")} THEN 'how_many' WHEN {_word("how much")} THEN 'how_much'
    WHEN {_word("what is")} THEN 'what_is' ELSE 'other' END"""
_TOKENS = f"len(regexp_extract_all(text, '[^{_SPACE}]+'))"


def _explicit(source: str, keys: str) -> str:
    return f"""WITH t AS (SELECT *, lower(text) AS low FROM {source}),
    ef AS (SELECT {keys}, text, CAST(length(text) AS INT) AS len_chars, CAST({_TOKENS} AS INT) AS len_tokens,
    CAST(len(regexp_extract_all(text, '[.!?]+')) + 1 AS INT) AS n_sentences,
    CAST(len(regexp_extract_all({_ASCII}, '\\b[0-9]+(\\.[0-9]+)?\\b')) AS INT) AS n_numbers,
    {_word(lx.FRACTION_WORDS)} AS has_fraction,
    regexp_matches(low, '{_L}[0-9]+[{_SPACE}]*%') OR {_word("percent")} AS has_percentage,
    regexp_matches(text, '\\$[0-9]+') OR {_word(lx.MONEY_WORDS)} AS has_money,
    {_word(lx.COMPARISON_WORDS)} AS has_comparison, {_word(lx.TIME_PATTERN)} AS has_time, {_QT} AS question_type FROM t)"""


_EXPLICIT_COLS = (
    "len_chars, len_tokens, n_sentences, n_numbers, has_fraction, has_percentage, has_money, has_comparison, "
    "has_time, question_type"
)

add(
    "b1_explicit_features",
    lambda s, d: tx.with_explicit_features(table(s, d, "documents")).drop("text", "lang", "source", "n_chars"),
    f"{_explicit('documents', 'doc_id')} SELECT doc_id, {_EXPLICIT_COLS} FROM ef",
)
add(
    "b1_explicit_features_turns",
    lambda s, d: tx.with_explicit_features(table(s, d, "conversations")).drop("text", "role"),
    f"{_explicit('conversations', 'conv_id, turn')} SELECT conv_id, turn, {_EXPLICIT_COLS} FROM ef",
)
add(
    "b2_question_type",
    lambda s, d: view(s, d, "problems").select("id", tx.question_type(F.col("question")).alias("question_type")),
    f"""{cte("problems")}, t AS (SELECT id, lower(question) AS low FROM problems) SELECT id, {_QT} AS question_type FROM t""",
)
_SEM = f"""sem AS (SELECT doc_id, text, least({_TOKENS} / 200e0, 1e0) AS token_cnt,
    CAST({_word(lx.NEGATION_WORDS, "lower(text)")} AS INT) AS has_neg,
    CAST({_word(lx.LOGIC_WORDS, "lower(text)")} AS INT) AS has_logic,
    CAST({_word(lx.QUANTIFIER_WORDS, "lower(text)")} AS INT) AS has_quant FROM documents)"""
add(
    "b3_semantic_features",
    lambda s, d: tx.with_semantic_features(table(s, d, "documents")).select(
        "doc_id", "token_cnt", "has_neg", "has_logic", "has_quant"
    ),
    f"WITH {_SEM} SELECT doc_id, token_cnt, has_neg, has_logic, has_quant FROM sem",
)


def _with_vectors(s, d):
    """Documents with the embedding of the same number, where there is one."""
    vec = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return table(s, d, "documents").join(vec, "doc_id", "left")


def _sparse_sql(vector: str, prefix: str) -> str:
    return f"""array_to_string(list_transform(list_filter(range(len({vector})), lambda i: abs({vector}[i + 1]) > 1e-6),
      lambda i: concat('{prefix}', i, ':', printf('%.4f', CAST({vector}[i + 1] AS DOUBLE)))), ' ')"""


add(
    "b4_format_features",
    lambda s, d: tx.with_feature_line(_with_vectors(s, d)).select("doc_id", "features"),
    f"""{_explicit("documents", "doc_id")}, h AS (SELECT doc_id, concat('|x len_chars:', printf('%.3f', len_chars / 1000e0),
      ' len_tokens:', printf('%.3f', len_tokens / 500e0), ' n_sentences:', n_sentences, ' n_numbers:', n_numbers,
      ' has_fraction:', CAST(has_fraction AS INT), ' has_percentage:', CAST(has_percentage AS INT),
      ' has_money:', CAST(has_money AS INT), ' has_comparison:', CAST(has_comparison AS INT),
      ' has_time:', CAST(has_time AS INT), ' qtype_', question_type, ':1') AS head FROM ef)
    SELECT doc_id, CASE WHEN vec_id IS NULL THEN head ELSE concat(head, ' |e ', {_sparse_sql("embedding", "")}) END AS features
    FROM h LEFT JOIN embeddings ON vec_id = doc_id""",
)
add(
    "b5_format_warm_features",
    lambda s, d: tx.with_feature_line(_with_vectors(s, d).filter(F.col("embedding").isNotNull()), warm=True).select(
        "doc_id", "features"
    ),
    f"""WITH {_SEM}, v AS (SELECT sem.*, list_transform(embedding,
      lambda x: greatest(least(CAST(x AS DOUBLE), 5e0), -5e0) / 5e0) AS e FROM sem JOIN embeddings ON vec_id = doc_id)
    SELECT doc_id, concat('|x ', {_sparse_sql("e", "pca_")}, ' |e token_cnt:', printf('%.4f', token_cnt), ' has_neg:', has_neg,
      ' has_logic:', has_logic, ' has_quant:', has_quant) AS features FROM v""",
)

# --- answers ---------------------------------------------------------------------------------

R = cte("responses")


def _x(pattern: str, text: str = "response") -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', 1), '')"


_MARK = f"""coalesce({_x(r"####\s*(-?[0-9]+\.?[0-9]*)")},
    list_last(regexp_extract_all(replace(response, ',', ''), '-?[0-9]+\\.?[0-9]*')))"""
_NUM = r"-?[0-9]+(?:\.[0-9]+)?"
_COT = f"""TRY_CAST(coalesce({_x(r"####\s*(-?[0-9]+)")}, {_x(r"(?i)(?:the\s+)?answer\s+is\s*:?\s*(-?[0-9]+)")},
    {_x(r"(?m)=\s*(-?[0-9]+)\s*$")}, list_last(regexp_extract_all(response, '-?[0-9]+'))) AS BIGINT)"""
_TAG = f"""TRY_CAST(round_even(TRY_CAST(coalesce({_x(rf"(?i)ANSWER:\s*({_NUM})")},
    {_x(rf"(?i)(?:final answer|the answer|answer is)[:\s]*({_NUM})")}, {_x(rf"(?m)=\s*({_NUM})\s*$")},
    {_x(rf"({_NUM})\s*$")}) AS DOUBLE), 0) AS BIGINT)"""
_STRICT = f"TRY_CAST({_x(r'####\s*(-?[0-9]+)')} AS BIGINT)"


def answers(s, d):
    return view(s, d, "responses")


add(
    "b6_answer_marker",
    lambda s, d: answers(s, d)
    .withColumn("answer", tx.answer_marker(F.col("response")))
    .select("id", "answer", F.col("answer").try_cast("double").alias("answer_value")),
    f"{R}, a AS (SELECT id, {_MARK} AS answer FROM responses) SELECT id, answer, TRY_CAST(answer AS DOUBLE) AS answer_value FROM a",
)
add(
    "b7_answer_cot",
    lambda s, d: answers(s, d).select("id", tx.answer_cot(F.col("response")).alias("answer")),
    f"{R} SELECT id, {_COT} AS answer FROM responses",
)
add(
    "b8_answer_tagged",
    lambda s, d: answers(s, d).select("id", tx.answer_tagged(F.col("response")).alias("answer")),
    f"{R} SELECT id, {_TAG} AS answer FROM responses",
)
add(
    "b9_answer_strict",
    lambda s, d: answers(s, d).select("id", tx.answer_strict(F.col("response")).alias("answer")),
    f"{R} SELECT id, {_STRICT} AS answer FROM responses",
)
add(
    "b10_grade",
    lambda s, d: answers(s, d).select("id", tx.grade(tx.answer_cot(F.col("response")), F.col("expected")).alias("correct")),
    f"{R} SELECT id, coalesce({_COT} = expected, false) AS correct FROM responses",
)
add(
    "b7_answer_cot_documents",
    lambda s, d: table(s, d, "documents").select("doc_id", tx.answer_cot(F.col("text")).alias("answer")),
    f"SELECT doc_id, {_COT.replace('response', 'text')} AS answer FROM documents",
)

# --- scrubbing, messages, code ---------------------------------------------------------------

_TOKEN_PATTERN = 'token = "[0-9a-f]+"'
_PATTERNS = [*lx.CREDENTIAL_PATTERNS, _TOKEN_PATTERN]


def _scrub_sql(text: str) -> str:
    for p in _PATTERNS:
        text = f"regexp_replace({text}, '{p}', '[REDACTED]', 'g')"
    return text


add(
    "b11_scrub_credentials",
    lambda s, d: tx.scrub_credentials(table(s, d, "documents"), ["text"], _PATTERNS).select(
        "doc_id", F.md5("text").alias("scrubbed"), F.regexp_count("text", F.lit(r"\[REDACTED\]")).alias("hits")
    ),
    f"""WITH t AS (SELECT doc_id, {_scrub_sql("text")} AS text FROM documents)
    SELECT doc_id, md5(text) AS scrubbed, CAST(len(regexp_extract_all(text, '\\[REDACTED\\]')) AS INT) AS hits FROM t""",
)


def _nested(s, d):
    """Scrubbing inside a map and an array built from the text."""
    docs = table(s, d, "documents").select(
        "doc_id", F.create_map(F.lit("text"), F.col("text")).alias("outputs"), F.split("text", "\n").alias("lines")
    )
    clean = tx.scrub_credentials(docs, ["outputs", "lines"], _PATTERNS)
    return clean.select(
        "doc_id", F.md5(F.col("outputs")["text"]).alias("scrubbed"), F.md5(F.array_join("lines", "\n")).alias("by_line")
    )


add(
    "b11_scrub_nested",
    _nested,
    f"""WITH t AS (SELECT doc_id, {_scrub_sql("text")} AS a, array_to_string(list_transform(string_split(text, chr(10)),
      lambda x: {_scrub_sql("x")}), chr(10)) AS b FROM documents)
    SELECT doc_id, md5(a) AS scrubbed, md5(b) AS by_line FROM t""",
)

# messages: the event log's kinds worded the way a solver words them, numbered by its own rows
_MSG = """WITH msg AS (SELECT event_id, CASE event_id % 8
    WHEN 0 THEN concat('<string>:', CAST(event_id % 50 AS VARCHAR(9)), ':1-2: error: syntax error, unexpected ', event_type)
    WHEN 1 THEN concat('unsafe variables in: ''X', CAST(event_id % 9 AS VARCHAR(9)), ''' at line 3')
    WHEN 2 THEN concat('atom undefined: ', event_type) WHEN 3 THEN concat('error in python script for ', event_type)
    WHEN 4 THEN 'integer division by 0' WHEN 5 THEN concat('Grounding Stopped on line ', CAST(event_id AS VARCHAR(19)))
    WHEN 6 THEN concat('parsing failed near ', event_type) ELSE concat('odd result: ', event_type) END AS message
    FROM {events})"""


def messages(s, d):
    return s.sql(_MSG + " SELECT * FROM msg", events=table(s, d, "events"))


_M = _MSG.replace("{events}", "events")
_SYN = " OR ".join(f"contains(low, '{w}')" for w in lx.SYNTAX_HINTS)
_GRO = " OR ".join(f"contains(low, '{w}')" for w in lx.GROUNDING_HINTS)
_LINE = "nullif(regexp_extract(message, '<string>:([0-9]+)', 1), '')"
_CLS = f"""cls AS (SELECT *, CASE WHEN {_SYN} THEN 'SYNTAX' WHEN {_GRO} OR contains(low, 'undefined') THEN 'GROUNDING'
      ELSE 'RUNTIME' END AS error_type, CASE WHEN {_SYN} THEN TRY_CAST({_LINE} AS INT) END AS error_line
    FROM (SELECT *, lower(message) AS low FROM msg))"""
add(
    "b12_classify_message",
    lambda s, d: messages(s, d).select(
        "event_id", *[c.alias(n) for n, c in tx.classify_message(F.col("message")).items()]
    ),
    f"{_M}, {_CLS} SELECT event_id, error_type, error_line FROM cls",
)
# rules made of the given tables: one per region for a type, one per event type for every type
_RULES = """SELECT r_regionkey AS position, CASE r_regionkey % 3 WHEN 0 THEN 'SYNTAX' WHEN 1 THEN 'GROUNDING' ELSE 'RUNTIME' END
      AS error_type, CAST(NULL AS VARCHAR(20)) AS mentions, r_name AS text FROM {region}
    UNION ALL SELECT DISTINCT 100 + length(event_type) AS position, CAST(NULL AS VARCHAR(20)) AS error_type, event_type AS mentions,
      concat('about ', event_type) AS text FROM {events}"""


def rules(s, d):
    return s.sql(_RULES, region=table(s, d, "region"), events=table(s, d, "events"))


add(
    "b13_annotate_errors",
    lambda s, d: tx.annotate_errors(
        messages(s, d).withColumn("error_type", tx.classify_message(F.col("message"))["error_type"]), rules(s, d)
    ).select("event_id", "error_type", F.array_join("advice", "|").alias("advice")),
    f"""{_M}, {_CLS}, rules AS ({_RULES.replace("{region}", "region").replace("{events}", "events")})
    SELECT event_id, c.error_type, coalesce(string_agg(r.text, '|' ORDER BY r.position, r.mentions NULLS FIRST, r.text), '') AS advice
    FROM cls c LEFT JOIN rules r ON (r.error_type IS NULL OR r.error_type = c.error_type)
      AND (r.mentions IS NULL OR contains(c.low, r.mentions)) GROUP BY 1, 2""",
)
_TRIM = r"regexp_replace({0}, '^[\s\x0b\x{{85}}\pZ]+|[\s\x0b\x{{85}}\pZ]+$', '', 'g')"


def _strip(x: str) -> str:
    return _TRIM.format(x)


def _code(text: str) -> str:
    blocks = " ".join(
        f"WHEN regexp_matches({text}, '(?is)```{t}\\n(.*?)```') THEN {_strip(f'regexp_extract({text}, {chr(39)}(?is)```{t}\\n(.*?)```{chr(39)}, 1)')}"
        for t in lx.CODE_TAGS
    )
    lines = f"list_filter(string_split({_strip(text)}, chr(10)), lambda x: NOT (starts_with({_strip('x')}, '#') OR starts_with({_strip('x')}, '**')))"
    flags = f"list_transform({lines}, lambda y: regexp_matches({_strip('y')}, '^[a-z_][\\p{{L}}\\p{{N}}_]*\\(|^%'))"
    start = f"list_position({flags}, true)"
    return f"""CASE {blocks} WHEN regexp_matches({text}, '[\\p{{L}}\\p{{N}}_]\\([^)]*\\)\\s*\\.') AND {start} > 0
      THEN {_strip(f"array_to_string(list_slice({lines}, {start}, len({lines})), chr(10))")} ELSE {_strip(text)} END"""


# documents wrapped in fences of varying tags, or as plain and code-like text
_FENCED = """WITH fenced AS (SELECT doc_id, CASE doc_id % 5
    WHEN 0 THEN concat('Here it is:', chr(10), '```asp', chr(10), text, chr(10), '```', chr(10), 'Done.')
    WHEN 1 THEN concat('```', chr(10), 'other', chr(10), '``` and ```Prolog', chr(10), text, '```')
    WHEN 2 THEN concat('# Title', chr(10), 'Intro words', chr(10), 'fact(a, 1).', chr(10), '**bold**', chr(10), text)
    WHEN 3 THEN concat(text, chr(10), '```', chr(10), '  rule(X) :- fact(X).  ', chr(10), '```') ELSE text END AS text FROM {documents})"""
add(
    "b14_extract_code_block",
    lambda s, d: s.sql(_FENCED + " SELECT * FROM fenced", documents=table(s, d, "documents")).select(
        "doc_id", F.md5(tx.extract_code_block(F.col("text"))).alias("code")
    ),
    f"{_FENCED.replace('{documents}', 'documents')} SELECT doc_id, md5({_code('text')}) AS code FROM fenced",
)
# each line of a conversation turn as a bullet of one of the three marks, or bare
_BULLETS = """WITH listed AS (SELECT conv_id, turn, concat('Items:', chr(10), ' - ', replace(text, chr(10), concat(chr(10),
    CASE (conv_id + turn) % 4 WHEN 0 THEN '- ' WHEN 1 THEN '* ' WHEN 2 THEN ' • ' ELSE '' END))) AS text FROM {conversations})"""
add(
    "b15_extract_bullets",
    lambda s, d: s.sql(_BULLETS + " SELECT * FROM listed", conversations=table(s, d, "conversations")).select(
        "conv_id", "turn", F.posexplode(tx.extract_bullets(F.col("text"))).alias("position", "entity")
    ),
    f"""{_BULLETS.replace("{conversations}", "conversations")}, b AS (SELECT conv_id, turn, list_transform(list_filter(
      list_transform(string_split(text, chr(10)), lambda x: {_strip("x")}),
      lambda y: starts_with(y, '- ') OR starts_with(y, '* ') OR starts_with(y, '• ')), lambda z: {_strip("substr(z, 3)")}) AS e
      FROM listed) SELECT conv_id, turn, CAST(i AS INT) AS position, e[i + 1] AS entity FROM b, range(100000) r(i) WHERE i < len(e)""",
)

P = cte("problems")


def problems(s, d):
    return view(s, d, "problems")


add(
    "b16_record_id",
    lambda s, d: problems(s, d).select(
        "id", tx.record_id(F.lit("noop"), F.col("template_id"), F.col("instance")).alias("record_id")
    ),
    f"{P} SELECT id, concat('noop_', template_id, '_', printf('%04d', instance)) AS record_id FROM problems",
)


def _topics_sql(words: dict, text: str) -> str:
    hits = ", ".join(
        f"CASE WHEN {' OR '.join(f'contains(lower({text}), {chr(39)}{w}{chr(39)})' for w in words[t])} THEN '{t}' END"
        for t in sorted(words)
    )
    return f"coalesce(nullif(concat_ws(',', {hits}), ''), 'general')"


add(
    "b24_detect_topics",
    lambda s, d: tx.with_topics(table(s, d, "documents")).select("doc_id", F.array_join("topics", ",").alias("topics")),
    f"SELECT doc_id, {_topics_sql(lx.TOPIC_WORDS, 'text')} AS topics FROM documents",
)
add(
    "b25_detect_template_topics",
    lambda s, d: tx.with_topics(table(s, d, "documents"), words=lx.TEMPLATE_TOPIC_WORDS).select(
        "doc_id", F.array_join("topics", ",").alias("topics")
    ),
    f"SELECT doc_id, {_topics_sql(lx.TEMPLATE_TOPIC_WORDS, 'text')} AS topics FROM documents",
)
_OBJ = r"[\p{L}\p{N}_]+"
_STOP = ", ".join(f"'{w}'" for w in lx.OBJECT_STOP_WORDS)


def objects_sql(text: str) -> str:
    found = " || ".join(
        f"regexp_extract_all(lower({text}), '{p}\\s+({_OBJ})', 1)" for p in ("[0-9]+", "the", "some", "many")
    )
    kept = f"list_sort(list_distinct(list_filter({found}, lambda w: w NOT IN ({_STOP}))))"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE ['items'] END"


add(
    "b26_extract_objects",
    lambda s, d: problems(s, d).select("id", F.array_join(tx.extract_objects(F.col("question")), ",").alias("objects")),
    f"{P} SELECT id, array_to_string({objects_sql('question')}, ',') AS objects FROM problems",
)
add(
    "b26_extract_objects_documents",
    lambda s, d: table(s, d, "documents").select(
        "doc_id", F.md5(F.array_join(tx.extract_objects(F.col("text")), ",")).alias("objects")
    ),
    f"SELECT doc_id, md5(array_to_string({objects_sql('text')}, ',')) AS objects FROM documents",
)
_QTY = f"""list_filter(list_transform(regexp_extract_all({_ASCII}, '\\b([0-9]+)\\b', 1), lambda x: TRY_CAST(x AS BIGINT)),
    lambda n: n > 0)"""
add(
    "b27_extract_quantities",
    lambda s, d: table(s, d, "documents").select(
        "doc_id",
        F.array_join(F.transform(tx.extract_quantities(F.col("text")), lambda n: n.cast("string")), ",").alias("quantities"),
        tx.max_quantity(F.col("text")).alias("max_quantity"),
    ),
    f"""WITH q AS (SELECT doc_id, {_QTY} AS q FROM documents)
    SELECT doc_id, coalesce(array_to_string(q, ','), '') AS quantities, coalesce(list_max(q), 10) AS max_quantity FROM q""",
)
add(
    "b28_attach_canary",
    lambda s, d: tx.attach_canary(problems(s, d)).select("id", "canary"),
    f"{P} SELECT id, '{tx.CANARY}' AS canary FROM problems",
)

# --- arithmetic over the event ledger --------------------------------------------------------


def _numbers(s, d):
    e = table(s, d, "events")
    return e.select(
        "event_id",
        (F.round(F.col("value") * 100).cast("bigint") - 2000).alias("a"),
        (F.col("event_id") % 13 - 6).alias("b"),
        (F.col("event_id") % 7 - 1).alias("e"),
    )


_NUMS = """WITH n AS (SELECT event_id, CAST(round(value * 100) AS BIGINT) - 2000 AS a, event_id % 13 - 6 AS b,
    event_id % 7 - 1 AS e FROM events)"""
_FD = "CAST(floor(CAST({0} AS DECIMAL(30,0)) / nullif({1}, 0)) AS BIGINT)"


def _fdiv(a: str, b: str) -> str:
    """Floor division from truncating // and %."""
    return f"(({a}) // nullif({b}, 0) - CASE WHEN ({a}) % nullif({b}, 0) <> 0 AND (({a}) < 0) <> (({b}) < 0) THEN 1 ELSE 0 END)"


def _fmod(a: str, b: str) -> str:
    return f"(({a}) % nullif({b}, 0) + CASE WHEN ({a}) % nullif({b}, 0) <> 0 AND (({a}) < 0) <> (({b}) < 0) THEN {b} ELSE 0 END)"


def _calc_all(s, d):
    n = _numbers(s, d)
    cols, a, b, e = [], F.col("a"), F.col("b"), F.col("e")
    for op in ("add", "sub", "mul", "div", "mod", "gt", "lt", "gte", "lte", "eq", "neq", "abs", "neg", "max", "min"):
        value, error = ar.calc(op, a, b)
        cols.append(value.alias(f"{op}_value"))
        if op in ("div", "mod"):
            cols.append(error.alias(f"{op}_error"))
    value, error = ar.calc("pow", b, e)
    return n.select("event_id", *cols, value.alias("pow_value"), error.alias("pow_error"))


add(
    "b21_integer_arithmetic",
    _calc_all,
    f"""{_NUMS} SELECT event_id, a + b AS add_value, a - b AS sub_value, a * b AS mul_value, {_fdiv("a", "b")} AS div_value,
    CASE WHEN b = 0 THEN 'error_div_zero' END AS div_error, {_fmod("a", "b")} AS mod_value,
    CASE WHEN b = 0 THEN 'error_mod_zero' END AS mod_error, CAST(a > b AS BIGINT) AS gt_value, CAST(a < b AS BIGINT) AS lt_value,
    CAST(a >= b AS BIGINT) AS gte_value, CAST(a <= b AS BIGINT) AS lte_value, CAST(a = b AS BIGINT) AS eq_value,
    CAST(a <> b AS BIGINT) AS neq_value, abs(a) AS abs_value, -a AS neg_value, greatest(a, b) AS max_value,
    least(a, b) AS min_value, CASE WHEN e >= 0 THEN CAST(power(b, e) AS BIGINT) END AS pow_value,
    CASE WHEN e < 0 THEN 'error_neg_exp' END AS pow_error FROM n""",
)
add(
    "b22_fixed_point",
    lambda s, d: _numbers(s, d).select(
        "event_id",
        ar.add(F.col("a"), F.col("b")).alias("dec_add"),
        ar.sub(F.col("a"), F.col("b")).alias("dec_sub"),
        ar.decimal_mul(F.col("a"), F.col("b")).alias("dec_mul"),
        ar.decimal_div(F.col("a"), F.col("b")).alias("dec_div"),
        ar.to_decimal(F.col("b"), F.col("e")).alias("dec_make"),
        ar.decimal_whole(F.col("a")).alias("dec_whole"),
        ar.decimal_frac(F.col("a")).alias("dec_frac"),
    ),
    f"""{_NUMS} SELECT event_id, a + b AS dec_add, a - b AS dec_sub, {_fdiv("a * b", "100")} AS dec_mul,
    {_fdiv("a * 100", "b")} AS dec_div, b * 100 + e AS dec_make, {_fdiv("a", "100")} AS dec_whole, abs(a) % 100 AS dec_frac FROM n""",
)
add(
    "b23_ratios",
    lambda s, d: _numbers(s, d).select(
        "event_id",
        ar.percent_of(F.col("b"), F.col("a")).alias("percent_of"),
        ar.as_percent(F.col("a"), F.col("b")).alias("as_percent"),
        ar.ratio_scale(F.col("a"), F.col("e"), F.col("b")).alias("ratio_scale"),
        ar.convert(F.col("a"), F.col("b")).alias("convert"),
        ar.convert_div(F.col("a"), F.col("b")).alias("convert_div"),
    ),
    f"""{_NUMS} SELECT event_id, {_fdiv("b * a", "100")} AS percent_of, {_fdiv("a * 100", "b")} AS as_percent,
    {_fdiv("a * e", "b")} AS ratio_scale, a * b AS convert, {_fdiv("a", "b")} AS convert_div FROM n""",
)

# --- record checks ---------------------------------------------------------------------------

_ERRS = """concat_ws(',', CASE WHEN coalesce(id, '') = '' THEN 'missing_id' END,
    CASE WHEN coalesce(question, '') = '' THEN 'missing_question' END, CASE WHEN coalesce(answer, '') = '' THEN 'missing_answer' END,
    CASE WHEN coalesce(template_id, '') = '' THEN 'missing_template_id' END,
    CASE WHEN NOT contains(coalesce(answer, ''), '####') THEN 'missing_marker' END,
    CASE WHEN TRY_CAST(final_answer AS DOUBLE) < 0 THEN 'negative_answer' END)"""
add(
    "c1_validate_records",
    lambda s, d: checks.validate_records(problems(s, d)).select("id", F.array_join("errors", ",").alias("errors")),
    f"{P} SELECT id, {_ERRS} AS errors FROM problems",
)
add(
    "c2_validation_report",
    lambda s, d: checks.validation_report(problems(s, d))[0],
    f"""{P}, e AS (SELECT {_ERRS} AS errors FROM problems) SELECT count(*) AS total_records,
    count(*) FILTER (errors = '') AS valid_records, count(*) FILTER (errors <> '') AS invalid_records FROM e""",
)
add(
    "c2_invalid_records",
    lambda s, d: checks.validation_report(problems(s, d))[1].select("id", F.array_join("errors", ",").alias("errors")),
    f"{P}, e AS (SELECT id, {_ERRS} AS errors FROM problems) SELECT * FROM e WHERE errors <> ''",
)
add(
    "c5_valid_answer",
    lambda s, d: table(s, d, "orders").select(
        "o_orderkey",
        checks.valid_answer((F.col("o_totalprice") * 10 - 100000).cast("string")).alias("price_ok"),
        checks.valid_answer(F.col("o_orderpriority")).alias("text_ok"),
    ),
    """SELECT o_orderkey, o_totalprice * 10 - 100000 BETWEEN 0 AND 1000000 AS price_ok, true AS text_ok FROM orders""",
)
_CONDITIONS = {
    "is_int": "is_int(x / y)",
    "divides": "divides(y, x)",
    "abs": "abs(x - y) < 10",
    "min_max": "min(x, y) >= 3 and max(x, y) <= 40",
    "chained": "2 < y <= x or not x != y",
    "floor": "x // y > 4 and x % y != 1",
}


def _conditions(s, d):
    numbers = table(s, d, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        F.floor("l_quantity").cast("double").alias("x"),
        (F.col("l_suppkey") % 12).cast("double").alias("y"),
    )
    names = {"x": F.col("x"), "y": F.col("y")}
    return numbers.select(
        *numbers.columns, *[checks.template_condition(c, names).alias(n) for n, c in _CONDITIONS.items()]
    )


add(
    "c6_template_conditions",
    _conditions,
    """WITH n AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(floor(l_quantity) AS DOUBLE) AS x,
      CAST(l_suppkey % 12 AS DOUBLE) AS y FROM lineitem)
    SELECT *, CASE WHEN y = 0 THEN false ELSE x / y = floor(x / y) END AS is_int,
    CASE WHEN y = 0 THEN false ELSE x - floor(x / y) * y = 0 END AS divides, abs(x - y) < 10 AS "abs",
    least(x, y) >= 3 AND greatest(x, y) <= 40 AS min_max, (2 < y AND y <= x) OR x = y AS chained,
    CASE WHEN y = 0 THEN false ELSE floor(x / y) > 4 AND x - floor(x / y) * y <> 1 END AS floor FROM n""",
)


def _records(s, d):
    """Problems as dataset records of two variants; priority-like halves by template parity."""
    p = problems(s, d)
    variant = F.when(F.col("instance") % 2 == 0, "base").otherwise("noop")
    return p.withColumn("variant", variant).withColumn("is_noop", F.col("variant") == "noop")


add(
    "a5_dataset_metadata",
    lambda s, d: metrics.dataset_metadata(_records(s, d)),
    f"""{P}, r AS (SELECT *, CASE WHEN instance % 2 = 0 THEN 'base' ELSE 'noop' END AS variant, {_ERRS} AS errors FROM problems)
    SELECT coalesce(variant, 'total') AS variant, count(*) AS generated, count(DISTINCT template_id) AS templates,
    count(*) FILTER (errors <> '') AS errors, count(*) FILTER (variant = 'noop') AS noop_records FROM r
    GROUP BY GROUPING SETS ((variant), ())""",
)
_META = f"""{P}, r AS (SELECT *, CASE WHEN instance % 2 = 0 THEN 'base' ELSE 'noop' END AS variant, {_ERRS} AS errors FROM problems)
    SELECT coalesce(variant, 'total') AS variant, count(*) AS generated, count(DISTINCT template_id) AS templates,
    count(*) FILTER (errors <> '') AS errors, count(*) FILTER (variant = 'noop') AS noop_records"""


def _metadata(s, d):
    path = scratch_path(s, "metadata")
    write_metadata(_records(s, d), path)
    back = read_metadata(s, path)
    return back.select("variant", "generated", "templates", "errors", "noop_records", "canary",
                       F.array_contains("fields", "question").alias("names_fields"), F.col("generated_at").isNotNull().alias("dated"))


add(
    "a5_metadata_document",
    _metadata,
    f"""{_META}, '{tx.CANARY}' AS canary, true AS names_fields, true AS dated FROM r GROUP BY GROUPING SETS ((variant), ())""",
)


def _summary(s, d):
    records = _records(s, d)
    asked = records.groupBy("variant", "template_id").agg((F.count(F.lit(1)) + 1).alias("instances"))
    return metrics.pipeline_summary(metrics.generation_stats(asked, records)).select(
        "variant", "instances_requested", "instances_generated", "instances_failed")


add(
    "a5_pipeline_summary",
    _summary,
    f"""{P}, r AS (SELECT *, CASE WHEN instance % 2 = 0 THEN 'base' ELSE 'noop' END AS variant FROM problems),
    v AS (SELECT variant, count(*) AS g, count(DISTINCT template_id) AS t FROM r GROUP BY 1)
    SELECT coalesce(variant, 'total') AS variant, CAST(sum(g + t) AS BIGINT) AS instances_requested,
    CAST(sum(g) AS BIGINT) AS instances_generated, CAST(sum(t) AS BIGINT) AS instances_failed
    FROM v GROUP BY GROUPING SETS ((variant), ())""",
)
add(
    "a9_load_problems",
    lambda s, d: load_problems(_records(s, d), ["base"], 500),
    f"""{P} SELECT id AS problem_id, question, CAST(TRY_CAST(final_answer AS DOUBLE) AS BIGINT) AS answer, template_id,
    'base' AS variant FROM problems WHERE instance % 2 = 0 ORDER BY id LIMIT 500""",
)
add(
    "e22_dimension_counts",
    lambda s, d: metrics.dimension_counts(view(s, d, "names")),
    f"""{cte("names")} SELECT coalesce(CAST(block AS VARCHAR), 'total') AS block, count(*) AS entries,
    count(DISTINCT name) AS distinct_names FROM names GROUP BY GROUPING SETS ((block), ())""",
)
