"""The queries once more as SQL for DuckDB, over the same parquet tables.

Each text is ``WITH`` the shared steps it names, then its own select. The derived inputs use the same
rule texts as ``derived``; results come from SQL's own functions, or from what the rules are known
to hold.
"""

from __future__ import annotations

import re

from parselab.functions import fixed
from workload import derived
from workload.catalog import PAIR_FLOOR, SWEEP


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def escaped(rule: str) -> str:
    """A rule text with its string literals in DuckDB's escape form."""
    return re.sub(r"'((?:[^'\\]|\\.)*)'", r"E'\1'", rule)


def fill(wording: str, **values: str) -> str:
    parts = re.split(r"\{(" + "|".join(values) + r")\}", wording)
    return " || ".join(
        f"coalesce(cast({values[p]} AS varchar), 'nan')" if at % 2 else lit(p) for at, p in enumerate(parts)
    )


WS, QUOTES, LF = lit(fixed.WHITESPACE), lit(fixed.QUOTES), "chr(10)"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def rest_of_line(t: str, phrase: str) -> str:
    return f"trim({strip(f'''regexp_extract({t}, '(?i){phrase}{chr(92)}s*([^{chr(92)}n{chr(92)}r]*)', 1)''')}, {QUOTES})"


def template_and_tier(t: str) -> str:
    """A struct of template and tier."""
    cases = [f"WHEN regexp_matches({t}, '(?i)TEMPLATE:') THEN {{'p': {rest_of_line(t, 'TEMPLATE:')}, 'tier': 1}}"]
    for phrase in fixed.TEMPLATE_PHRASES:
        cases.append(
            f"WHEN regexp_matches({t}, '(?i){phrase}') THEN {{'p': {rest_of_line(t, phrase + ':?')}, 'tier': 2}}"
        )
    stripped = f"list_transform(string_split({t}, {LF}), lambda l: {strip('l')})"
    line = f"list_filter({stripped}, lambda l: contains(l, '<*>') AND length(l) BETWEEN 6 AND 299)[1]"
    opener = "(?i)^(" + "|".join(fixed.LINE_OPENERS) + r"):?\s*"
    cases.append(
        f"WHEN {line} IS NOT NULL THEN {{'p': trim(regexp_replace({line}, {lit(opener)}, ''), {QUOTES}), 'tier': 3}}"
    )
    first = strip(f"string_split({t}, {LF})[1]")
    cases.append(f"WHEN {first} <> '' THEN {{'p': {first}, 'tier': 4}}")
    return f"CASE {' '.join(cases)} ELSE {{'p': {t}, 'tier': 5}} END"


def without_tokens(x: str) -> str:
    for token in fixed.SPECIAL_TOKENS:
        x = f"replace({x}, {lit(token)}, '')"
    return x


def with_marker(x: str) -> str:
    line = strip(f"list_filter(string_split({x}, {LF}), lambda l: contains(l, '<*>'))[1]")
    body = (
        f"CASE WHEN NOT contains({x}, 'TEMPLATE:') AND contains({x}, '<*>')"
        f" THEN {x} || {LF} || {LF} || 'TEMPLATE: ' || {line} ELSE {x} END"
    )
    return f"{strip(body)} || repeat({LF}, 4)"


def cleaned(x: str) -> str:
    x = f"replace({x}, '</think>', ' ')"
    x = f"regexp_replace({x}, '(?s)```.*?```', ' ', 'g')"
    x = f"regexp_replace({x}, '## Step [0-9]+:.*?\\n', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)\\$\\\\boxed\\{{(.*?)\\}}\\$', '\\1', 'g')"
    return f"regexp_replace({x}, '(?s)\\$?\\\\boxed\\{{(.*?)\\}}\\$?', '\\1', 'g')"


def by_marker(x: str) -> str:
    tail = f"trim(string_split(lower({x}), 'error_summary:')[-1], {lit(fixed.WHITESPACE + fixed.QUOTES)})"
    return f"CASE WHEN contains(lower({x}), 'error_summary:') THEN regexp_replace({tail}, '\\s+', ' ', 'g') END"


def last_paragraph(x: str) -> str:
    body = strip(x)
    return f"CASE WHEN {body} <> '' THEN {strip(f'''regexp_split_to_array({body}, '{chr(92)}n{chr(92)}s*{chr(92)}n')[-1]''')} END"


def shortened(x: str) -> str:
    return f"CASE WHEN length({x}) > 1000 THEN substr({x}, 1, 997) || '...' ELSE {x} END"


def order(key: str) -> str:
    return f"md5('42|' || {key}), {key}"


KIND = "cast('0x' || substr(md5({0}), 1, 4) AS int) % 8"
LABEL = "CASE WHEN {0} = 0 THEN 'Invalid_Label' ELSE 'Type ' || {0} END"


def label_rows(types: str) -> str:
    number = f"cast(CASE WHEN row_id % 7 = 0 THEN 0 ELSE 1 + (user_id * user_id + row_id) % {types} END AS int)"
    return f"""SELECT *, {LABEL.format('"Error_Number"')} AS "Error_Type" FROM (
      SELECT row_id, "Content" AS "Original_Log", "EventTemplate" AS "Correct_Template", {number} AS "Error_Number"
      FROM logs)"""


def walk(intended: bool) -> str:
    """Final target of every plan row, by following the plan one step at a time."""
    later = "true" if intended else "p.seq > w.seq"
    skip = "WHERE from_type <> to_type" if intended else ""
    return f"""SELECT from_type, arg_max(cur, depth) AS to_type FROM (
      WITH RECURSIVE w AS (
        SELECT from_type, to_type AS cur, seq, 1 AS depth FROM plan {skip}
        UNION ALL
        SELECT w.from_type, p.to_type, p.seq, w.depth + 1 FROM w
        JOIN (SELECT * FROM plan {skip}) p ON p.from_type = w.cur AND {later})
      SELECT * FROM w) GROUP BY 1"""


BLOCK_TEXT = """'#### ' || chr(cast(64 + number AS int)) || '. ' || title || chr(10) || '- ' || description || chr(10)
  || '- Example errors:' || chr(10) || list_aggregate(list_transform(examples, lambda e: '  - "' || e || '"' || chr(10)), 'string_agg', '')"""


def variant_lists() -> str:
    def rows(*items: tuple[str, str, str]) -> str:
        made = ", ".join(f"{{'i': {i}, 'o': {o}, 'e': {e}}}" for i, o, e in items)
        return f"[{made}]"

    none = "NULL::int"
    x = [(f"c || ' x{n}'", "t", none) for n in range(10)]
    y = [(f"c || ' y{n}'", f"t || ' y{n}'", none) for n in range(10)]
    broken = ("""'["' || c || ' x1", oops]'""", "t", none)
    typed = ("""'[{"example": "' || c || ' y1", "template": 5}]'""", "t", none)
    one = [rows(x[1], x[2], x[3]), rows(x[1], x[2]), rows(x[1]), rows(x[1], x[2]), rows(broken, x[9]), rows(x[1]),
           rows(x[1], x[1], x[2])]
    two = [rows(y[1], (y[2][0], y[2][1], "3")), rows(y[1]), rows(y[1]), rows(y[1]), rows(typed), rows(y[1]),
           rows(y[1], y[1]), rows(("c || ' y1'", "t", none), ("c || ' y2'", "t", none))]
    first = " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(one))
    other = " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(two))
    empty = "[]::STRUCT(i VARCHAR, o VARCHAR, e INTEGER)[]"
    return f"CASE WHEN strategy = 1 THEN CASE kind {first} ELSE {empty} END ELSE CASE kind {other} END END"


STEPS: dict[str, str] = {
    "logs": """SELECT event_id AS row_id, user_id, event_type,
      CASE WHEN user_id % 3 = 0 THEN 'sys0' ELSE 'sys' || (user_id % 5) END AS system,
      CASE WHEN event_id % 8 = 3 THEN 'user 7 ' || event_type || ' value=100 k=1' ELSE 'user ' || user_id || ' '
        || event_type || ' value=' || cast(round(value * 100) AS bigint) || ' k=' || json_extract_string(props, '$.k') END AS "Content",
      'user <*> ' || event_type || ' value=<*> k=<*>' AS "EventTemplate" FROM events""",
    "answers": f'SELECT *, {escaped(derived.OUTPUT_RULE)} AS response FROM logs',
    "normal": f"""SELECT * EXCLUDE (clean), {with_marker('clean')} AS reasoning
      FROM (SELECT *, {without_tokens('response')} AS clean FROM answers WHERE response IS NOT NULL)""",
    "found": f"SELECT *, {template_and_tier('reasoning')} AS f FROM normal",
    "scored": f"""SELECT * EXCLUDE (f), f.p AS "Prediction", f.tier AS tier,
      CASE WHEN {strip('f.p')} = {strip('"EventTemplate"')} THEN 'same' ELSE 'diff' END AS outcome FROM found""",
    "wrong": """SELECT row_id, system, "Content", reasoning, "EventTemplate" FROM scored WHERE outcome = 'diff'""",
    "labelled": label_rows(str(derived.TYPES)),
    "wide": label_rows("(SELECT count(*) FROM embeddings)"),
    "summaries": """SELECT row_id * 2 + copy AS seq, ' ' || "Content" || '  ' AS original_log,
      "EventTemplate" AS correct_template,
      CASE WHEN row_id % 11 = 0 THEN NULL WHEN row_id % 17 = 0 THEN '  too short '
        ELSE '  Template for ' || event_type || ' split wrongly at ' || string_split("Content", '=')[-1]
          || ' copy ' || copy END AS error_summary
      FROM (SELECT *, unnest(range(0, CASE WHEN row_id % 13 = 0 THEN 2 ELSE 1 END)) AS copy FROM logs)""",
    "valid": f"""SELECT seq, {strip('error_summary')} AS error_summary, row_number() OVER (ORDER BY {order('seq')}) AS position
      FROM summaries WHERE length({strip('error_summary')}) > 10""",
    "types": """SELECT label + 1 AS number, label AS pos, 'Type ' || (label + 1) AS title,
      'Seen in ' || count(*) || ' vectors' AS description,
      ['example ' || (label + 1) || 'a', 'example ' || (label + 1) || 'b', 'example ' || (label + 1) || 'c'] AS examples
      FROM embeddings GROUP BY label""",
    "options": f"""SELECT string_agg(number || ' (' || chr(cast(64 + number AS int)) || '): ' || title || {LF}, '' ORDER BY pos) AS options,
      count(*) AS n FROM types""",
    "document": f"""SELECT {lit(fixed.MERGED_HEADER.format(threshold=fixed.SIMILARITY_THRESHOLD))} || {LF}
      || string_agg({BLOCK_TEXT}, {LF} ORDER BY number) || {LF} AS document FROM types""",
    "markdown": f"""SELECT doc_id, '# Types' || {LF} || {LF} || array_to_string(list_transform(string_split(text, {LF}),
      lambda l, i: '#### ' || chr(cast(65 + (i - 1) % 26 AS int)) || '. ' || l || {LF} || '- ' || l
        || {LF} || 'more' || {LF} || '- Example errors: inline' || {LF} || '  - "' || l || '"' || {LF}), {LF}) AS text
      FROM documents""",
    "chunks": """SELECT doc_id, unnest(list_transform(list_filter(string_split(text, '####'),
        lambda c: regexp_full_match(c, '(?s) [A-Z]\\. [^\\n]+\\n- [^#]+')), lambda c, i: {'pos': i - 1, 'c': c})) AS s FROM markdown""",
    "bodies": f"""SELECT doc_id, s.pos AS pos, substr(s.c, 2, 1) AS letter,
      {strip("regexp_extract(s.c, '^ [A-Z][.] ([^' || chr(10) || ']+)', 1)")} AS title,
      list_transform(string_split({strip("regexp_extract(s.c, '(?s)^ [A-Z][.] [^' || chr(10) || ']+' || chr(10) || '- (.*)$', 1)")}, {LF}),
        lambda l: {strip('l')}) AS body FROM chunks""",
    "headed": """SELECT *, coalesce(list_position(list_transform(body,
        lambda l: starts_with(l, '- Example errors:') OR starts_with(l, '- Examples:')), true), 0) AS head FROM bodies""",
    "parts": f"""SELECT doc_id, pos, letter, title,
      {strip('''array_to_string(list_transform(list_filter(CASE WHEN head > 0 THEN body[1:head - 1] ELSE body END,
        lambda l: starts_with(l, '- ') OR NOT starts_with(l, '-')),
        lambda l: CASE WHEN starts_with(l, '- ') THEN substr(l, 3) ELSE l END), ' ')''')} AS description,
      list_transform(list_filter(CASE WHEN head > 0 THEN body[head + 1:] ELSE [] END, lambda l: starts_with(l, '- "')),
        lambda l: CASE WHEN ends_with(substr(l, 4), '"') THEN substr(l, 4, greatest(length(l) - 4, 0)) ELSE substr(l, 4) END) AS examples
      FROM headed""",
    "blocks": """SELECT doc_id, letter, min(pos) AS pos, arg_max(title, pos) AS title, arg_max(description, pos) AS description,
      arg_max(examples, pos) AS examples FROM parts GROUP BY 1, 2""",
    "surviving": """SELECT * FROM blocks b WHERE NOT EXISTS (
      SELECT 1 FROM blocks m WHERE m.doc_id = b.doc_id AND m.title = b.title AND m.pos % 3 = 2)""",
    "seeds": f"""SELECT *, row_id AS seed_id, CASE WHEN row_id % 5 <> 0 THEN 'Wrong split at ' || row_id ELSE '' END AS error_summary,
      cast(cast('0x' || substr(md5('42|' || row_id), 1, 8) AS bigint) % 3 + 1 AS int) AS strategy,
      {KIND.format('"Original_Log"')} AS kind, "Original_Log" AS c, "Correct_Template" AS t FROM labelled""",
    "first_lists": f"SELECT *, {variant_lists()} AS v FROM seeds",
    "variants": """SELECT seed_id, strategy, u.pos AS pos, u.i AS input, u.o AS output, u.e AS error_type FROM (
      SELECT seed_id, strategy, unnest(list_transform(v, lambda s, n: {'pos': n - 1, 'i': s.i, 'o': s.o, 'e': s.e})) AS u
      FROM first_lists)""",
    "asked": f"""SELECT *, md5({lit(fixed.ERROR_SYSTEM)} || chr(31) || {fill(fixed.ERROR_USER, log='"Content"', reasoning='reasoning', template='"EventTemplate"')}) AS request_id,
      {KIND.format('"Content"')} AS kind FROM wrong""",
    "replied": f"""SELECT *, CASE WHEN length("Content") % 9 <> 0 THEN {escaped(derived.SUMMARY_REPLY)} END AS response FROM asked""",
    "stored": f"""SELECT *, {escaped(derived.SUMMARY_REPLY)} AS response
      FROM (SELECT *, {KIND.format('"Content"')} AS kind FROM logs)""",
    "judged": f"""SELECT *, {KIND.format('"Content"')} AS kind, 1 + length("Content") % 10 AS n FROM wrong""",
    "parsed": """SELECT row_id, "Content" AS "Original_Log", "EventTemplate" AS "Correct_Template",
      CASE WHEN kind = 0 THEN 'Named ' || n WHEN kind IN (1, 4) THEN 'Invalid_Label' WHEN kind = 2 THEN 'No_JSON_Found'
        WHEN kind = 3 THEN 'JSON_Parse_Error' WHEN kind IN (5, 6) THEN 'Type ' || n
        WHEN length("Content") % 3 = 0 THEN 'Empty_Response' WHEN length("Content") % 3 = 1 THEN 'No_Response'
        ELSE 'API_Error' END AS "Error_Type",
      cast(CASE WHEN kind IN (0, 5, 6) THEN n ELSE 0 END AS int) AS "Error_Number" FROM judged""",
    "turns": f"""SELECT *, row_number() OVER (PARTITION BY "Error_Number" ORDER BY {order('row_id')}) AS turn,
      dense_rank() OVER (ORDER BY "Error_Number") - 1 AS place FROM labelled""",
    "slots": """SELECT *, (turn - 1) * (SELECT count(DISTINCT "Error_Number") FROM labelled) + place AS slot FROM turns""",
    "joined": f"""SELECT l.row_id, l."Error_Number", s.error_summary FROM labelled l JOIN (
      SELECT {strip('original_log')} AS k1, {strip('correct_template')} AS k2, error_summary,
        row_number() OVER (PARTITION BY original_log, correct_template ORDER BY seq DESC) AS back FROM summaries) s
      ON s.k1 = {strip('l."Original_Log"')} AND s.k2 = {strip('l."Correct_Template"')} AND s.back = 1""",
    "copied": """SELECT vec_id * 2 AS pos, embedding::DOUBLE[] AS v FROM embeddings
      UNION ALL SELECT vec_id * 2 + 1, list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN (i - 1) % 7 = 0 THEN x / 3 ELSE x END)
      FROM embeddings""",
    "copied_cosines": """SELECT a.pos AS i, b.pos AS j, list_cosine_similarity(a.v, b.v) AS sim
      FROM copied a JOIN copied b ON a.pos < b.pos""",
    "cosines": """SELECT a.vec_id AS i, b.vec_id AS j,
      list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
      FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id""",
    "pairs": f"SELECT * FROM cosines WHERE sim > {PAIR_FLOOR}",
    "totals": """SELECT "Error_Type" AS title, count(*) AS n FROM wide GROUP BY 1""",
    "counted": """SELECT p.i, p.j, p.sim, 'Type ' || (p.i + 1) AS type_1, 'Type ' || (p.j + 1) AS type_2,
      coalesce(a.n, 0) AS count_1, coalesce(b.n, 0) AS count_2 FROM pairs p
      LEFT JOIN totals a ON a.title = 'Type ' || (p.i + 1) LEFT JOIN totals b ON b.title = 'Type ' || (p.j + 1)""",
    "decided": """SELECT CASE WHEN count_1 > count_2 THEN type_2 ELSE type_1 END AS from_type,
      CASE WHEN count_1 > count_2 THEN type_1 ELSE type_2 END AS winner, i, j, i * 10000000 + j AS seq FROM counted""",
    "plan": """SELECT from_type, arg_max(winner, seq) AS to_type, min(seq) AS seq, arg_min(i, seq) AS first_i,
      arg_min(j, seq) AS first_j FROM decided GROUP BY 1""",
    "closed": walk(intended=True),
    "applied": walk(intended=False),
    "remapped": """SELECT w.row_id, w."Error_Number", w."Error_Type" AS old, coalesce(a.to_type, w."Error_Type") AS "Error_Type"
      FROM wide w LEFT JOIN applied a ON a.from_type = w."Error_Type" """,
    "observed_slots": """SELECT system, "EventTemplate" AS template, slot,
      CASE slot WHEN 1 THEN string_split("Content", ' ')[2] WHEN 2 THEN string_split(string_split("Content", 'value=')[2], ' ')[1]
        ELSE string_split("Content", ' k=')[2] END AS value
      FROM (SELECT *, cast(unnest([1, 2, 3]) AS int) AS slot FROM logs)""",
    "slot_pool": """SELECT *, row_number() OVER (PARTITION BY system, template, slot ORDER BY md5('42|' || value), value) AS pick,
      count(*) OVER (PARTITION BY system, template, slot) AS size
      FROM (SELECT DISTINCT system, template, slot, value FROM observed_slots)""",
    "wanted": """SELECT l.system, s.seed_id, s."Correct_Template" AS template, p.place, q.slot,
      cast('0x' || substr(md5('42|' || s.seed_id || '|' || p.place || '|' || q.slot), 1, 8) AS bigint) AS h
      FROM seeds s JOIN logs l ON l.row_id = s.seed_id, (SELECT unnest([1, 2, 3]) AS place) p, (SELECT unnest([1, 2, 3]) AS slot) q""",
    "refilled": """SELECT w.seed_id, w.place, w.template, list(v.value ORDER BY w.slot) AS v FROM wanted w
      JOIN (SELECT DISTINCT system, template, slot, size FROM slot_pool) z
        ON z.system = w.system AND z.template = w.template AND z.slot = w.slot
      JOIN slot_pool v ON v.system = w.system AND v.template = w.template AND v.slot = w.slot AND v.pick = w.h % z.size + 1
      GROUP BY 1, 2, 3""",
    "round_lists": """SELECT *, CASE WHEN len(v) >= 4 THEN v ELSE list_concat(v, CASE WHEN kind % 2 = 1 THEN []
      WHEN strategy = 1 THEN list_transform(range(1, 5 - len(v)), lambda r: {'i': c || ' r' || r, 'o': t, 'e': NULL::int})
      ELSE list_transform(range(1, 5 - len(v)), lambda r: {'i': c || ' r' || r, 'o': t || ' r' || r, 'e': NULL::int}) END) END AS w
      FROM first_lists""",
}

# The block steps once more for the reader as it is meant: only a heading ends a block, and the example on the line
# of the example heading (the same in every block of the fixture) counts.
_CHAIN = ("chunks", "bodies", "headed", "parts", "blocks")
for _name in _CHAIN:
    _text = STEPS[_name].replace("\\n- [^#]+'", "\\n- [^#].*'")
    if _name == "parts":
        _text = _text.replace(
            "list_transform(list_filter(CASE WHEN head > 0 THEN body[head + 1:]",
            "list_concat(CASE WHEN head > 0 THEN ['inline'] ELSE [] END, list_transform(list_filter(CASE WHEN head > 0 THEN body[head + 1:]",
        ).replace("END) AS examples", "END)) AS examples")
    STEPS[f"{_name}_loose"] = re.sub(rf"\bFROM ({'|'.join(_CHAIN)})\b", r"FROM \1_loose", _text)


def named_steps(text: str) -> list[str]:
    """The shared steps a text needs, in order."""
    needed: set[str] = set()
    open_texts = [text]
    while open_texts:
        current = open_texts.pop()
        for name in STEPS:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", current):
                needed.add(name)
                open_texts.append(STEPS[name])
    return [name for name in STEPS if name in needed]


def statement(text: str) -> str:
    steps = ",\n".join(f"{name} AS ({STEPS[name]})" for name in named_steps(text))
    return f"WITH {steps}\n{text}" if steps else text


SEED_FIELDS = {"log": '"Original_Log"', "template": '"Correct_Template"', "summary": "error_summary", "type": '"Error_Type"'}


def _by_strategy(one: str, two: str, three: str) -> str:
    return f"CASE strategy WHEN 1 THEN {one} WHEN 2 THEN {two} ELSE {three} END"


def _augment_prompt() -> str:
    fields = {**SEED_FIELDS, "count": "7"}
    semantic = fill(
        fixed.AUGMENT_SEMANTIC, document="(SELECT document FROM document)", types="10", number='"Error_Number"', **fields
    )
    return _by_strategy(fill(fixed.AUGMENT_SUBSTITUTE, **fields), fill(fixed.AUGMENT_REWRITE, **fields), semantic)


def _topup_prompt() -> str:
    made = f"coalesce(list_aggregate(list_transform(v, lambda s: '- ' || s.i), 'string_agg', {LF}), '')"
    fields = {**SEED_FIELDS, "count": "3 - len(v)", "existing": made}
    semantic = fill(fixed.TOPUP_SEMANTIC, document="(SELECT document FROM document)", number='"Error_Number"', **fields)
    return _by_strategy(fill(fixed.TOPUP_SUBSTITUTE, **fields), fill(fixed.TOPUP_REWRITE, **fields), semantic)


PERCENT = "CASE WHEN {1} > 0 THEN round({0} / {1} * 100, 6) ELSE 0.0 END"
TUNING = f"""{lit(fixed.INSTRUCTION)} AS instruction, "Original_Log" AS input, "Correct_Template" AS output"""
SAMPLE_SIZE = "CASE WHEN n > 500 THEN 500 ELSE least(n, 200) END"
OVERVIEW = f"""SELECT total, n AS valid, cast({SAMPLE_SIZE} AS bigint) AS sampled FROM (
  SELECT (SELECT count(*) FROM summaries) AS total, (SELECT count(*) FROM valid) AS n)"""

SELECTS: dict[str, str] = {
    # sources and sinks
    "scan_logs": f"""SELECT "Content" || {LF} || 'second "quoted" line, ' || event_type AS "Content",
      CASE WHEN row_id % 19 <> 0 THEN "EventTemplate" END AS "EventTemplate" FROM logs""",
    "required_columns": " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, {str(here).lower()} AS present, count(*) AS rows,
        {f'count(*) - count({c})' if here else 'count(*)'} AS missing FROM summaries"""
        for c, here in [*((c, True) for c in fixed.SUMMARY_COLUMNS), ("Error_Type", False), ("Error_Number", False)]
    ),
    "taxonomy_scan": f"""SELECT doc_id, cast(unicode(upper(letter)) - 64 AS bigint) AS number, arg_max(title, pos) AS title FROM (
      SELECT doc_id, pos, {strip("substr(rest, 1, instr(rest, '. ') - 1)")} AS letter,
        {strip("substr(rest, instr(rest, '. ') + 2)")} AS title FROM (
        SELECT doc_id, s.pos AS pos, {strip("replace(s.l, '####', '')")} AS rest FROM (
          SELECT doc_id, unnest(list_transform(string_split(text, {LF}), lambda l, i: {{'pos': i, 'l': {strip('l')}}})) AS s
          FROM markdown) WHERE starts_with(s.l, '####') AND contains(s.l, '. ')) WHERE contains(rest, '. '))
      WHERE regexp_matches(letter, '^\\pL$') GROUP BY 1, 2""",
    "taxonomy_blocks": """SELECT doc_id, letter, title, description, array_to_string(examples, '|') AS examples FROM blocks""",
    "taxonomy_blocks_intended": """SELECT doc_id, letter, title, description, array_to_string(examples, '|') AS examples
      FROM blocks_loose""",
    "sink_partitioned": """SELECT "Content", "Prediction", reasoning, "EventTemplate", outcome FROM scored""",
    "sink_append": "SELECT original_log, correct_template, error_summary FROM summaries",
    "sink_overwrite": """SELECT "Original_Log", "Correct_Template", "Error_Type", "Error_Number" FROM labelled""",
    "taxonomy_doc_out": f"""SELECT u.place AS place, u.line AS line FROM (
      SELECT unnest(list_transform(string_split({lit(fixed.MERGED_HEADER.format(threshold=0.85))} || {LF} || body, {LF}),
        lambda l, i: {{'place': i, 'line': l}})) AS u FROM (
        SELECT string_agg({BLOCK_TEXT}, {LF} ORDER BY number) AS body FROM types))""",
    "analysis_document": f"""SELECT {fill(fixed.ANALYSIS_HEADER, sampled='sampled', total='total', valid='valid',
      source="'summaries'", model="'model'")} || (SELECT document FROM document) AS document FROM ({OVERVIEW})""",
    "sink_tuning_json": f"SELECT {TUNING} FROM labelled",
    "run_summary": f"""SELECT 'success' AS status, count(*) AS processed, count(*) FILTER (outcome = 'same') AS correct,
      {PERCENT.format("count(*) FILTER (outcome = 'same')", "count(*)")} AS accuracy, 'logs' AS input_file, 'out' AS output_dir
      FROM scored""",
    # projections and filters
    "drop_null_rows": "SELECT seq, error_summary FROM summaries WHERE original_log IS NOT NULL AND error_summary IS NOT NULL",
    "drop_empty_rows": """SELECT seed_id, error_summary FROM seeds WHERE error_summary <> '' AND "Original_Log" <> '' """,
    "clean_summaries": "SELECT seq, error_summary FROM valid",
    "outcome_split": 'SELECT row_id, "Prediction", outcome FROM scored',
    "prompt_template": f"""SELECT row_id, {fill(fixed.PARSE_PROMPT, log='"Content"')} AS prompt FROM logs""",
    "prompt_error": f"""SELECT row_id, {lit(fixed.ERROR_SYSTEM)} AS system_prompt,
      {fill(fixed.ERROR_USER, log='"Content"', reasoning='reasoning', template='"EventTemplate"')} AS prompt FROM wrong""",
    "prompt_classify": f"""SELECT row_id, {fill(
        fixed.CLASSIFY_USER, options='(SELECT options FROM options)', count='(SELECT n FROM options)', log='"Content"',
        reasoning='reasoning', template='"EventTemplate"')} AS prompt FROM wrong""",
    "prompt_augment": f"SELECT seed_id, strategy, {_augment_prompt()} AS prompt FROM seeds",
    "prompt_topup": f"SELECT seed_id, strategy, {_topup_prompt()} AS prompt FROM first_lists WHERE len(v) < 3",
    "tuning_rows": f"""SELECT 'observed' AS mode, seed_id, {lit(fixed.INSTRUCTION)} AS instruction, "Original_Log" AS input,
        CASE WHEN seed_id % 23 <> 0 THEN "Correct_Template" ELSE 'nan' END AS output FROM seeds
      UNION ALL SELECT 'intended', seed_id, {TUNING} FROM seeds WHERE seed_id % 23 <> 0""",
    "tuning_rename": f"""SELECT seed_id, {lit(fixed.INSTRUCTION)} AS prompt, "Original_Log" AS query, "Correct_Template" AS response
      FROM seeds""",
    "column_order": """SELECT "Original_Log", "Correct_Template", error_summary, "Error_Type", "Error_Number" FROM seeds""",
    "not_identical": """SELECT v.seed_id, cast(v.pos AS int) AS pos, v.input FROM variants v JOIN logs l ON l.row_id = v.seed_id
      WHERE v.input <> l."Content" """,
    "line_candidates": f"""SELECT doc_id, cast(s.pos AS int) AS pos, s.l AS candidate FROM (
      SELECT doc_id, unnest(list_transform(list_filter(list_transform(string_split({strip('text')}, {LF}), lambda l: {strip('l')}),
        lambda l: length(l) > 5 AND NOT starts_with(l, '```') AND NOT starts_with(l, '/*') AND NOT starts_with(l, '*/')),
        lambda l, i: {{'pos': i - 1, 'l': l}})) AS s FROM documents)""",
    # text extraction
    "strip_markers": f"""SELECT row_id, {without_tokens("('<s<unk>>' || response || '<|user|><</s>s>')")} AS output FROM answers""",
    "inject_marker": f"SELECT row_id, {with_marker('response')} AS output FROM answers",
    "extract_template": f"""SELECT row_id, f.p AS template, f.tier AS tier FROM (
      SELECT row_id, {template_and_tier('response')} AS f FROM answers WHERE response IS NOT NULL)""",
    "extract_tiers": "SELECT tier, outcome, count(*) AS rows FROM scored GROUP BY 1, 2",
    "clean_reasoning": f"SELECT row_id, {cleaned('response')} AS cleaned FROM stored",
    "summary_by_marker": f"SELECT row_id, {by_marker('response')} AS error_summary FROM stored",
    "summary_fallback": f"SELECT doc_id, {last_paragraph('text')} AS paragraph FROM documents",
    "summary_final": f"""SELECT row_id, coalesce({shortened('p')}, '') AS observed,
      coalesce({shortened("coalesce(nullif(m, ''), p)")}, '') AS intended FROM (
        SELECT row_id, {last_paragraph('x')} AS p, {by_marker('x')} AS m FROM (
          SELECT row_id, {cleaned("coalesce(response, '')")} AS x FROM replied))""",
    "json_slice": f"""SELECT row_id, CASE WHEN contains(r, '{{') AND contains(r, '}}') THEN
        substr(r, instr(r, '{{'), greatest(length(r) - instr(reverse(r), '}}') + 2 - instr(r, '{{'), 0)) END AS slice
      FROM (SELECT row_id, {strip(escaped(derived.LABEL_REPLY))} AS r FROM judged)""",
    "label_validate": """SELECT row_id, "Original_Log", "Correct_Template", "Error_Type", "Error_Number" FROM parsed""",
    "variants_substitution": "SELECT seed_id, cast(pos AS int) AS pos, input, output FROM variants WHERE strategy = 1",
    "variants_rewrite": "SELECT seed_id, cast(pos AS int) AS pos, input, output FROM variants WHERE strategy = 2",
    "variants_semantic": "SELECT seed_id, cast(pos AS int) AS pos, input, output, error_type FROM variants WHERE strategy = 3",
    "letter_number": """SELECT doc_id, letter, cast(unicode(letter) - 64 AS int) AS number, letter AS again FROM blocks""",
    "template_match": """SELECT row_id, regexp_full_match("Content", array_to_string(list_transform(string_split("EventTemplate", '<*>'),
        lambda p: regexp_escape(p)), '(.+?)')) AS gold_matches,
      regexp_full_match("Content", array_to_string(list_transform(string_split("Prediction", '<*>'),
        lambda p: regexp_escape(p)), '(.+?)')) AS prediction_matches FROM scored WHERE "Prediction" <> '' """,
    # joins
    "label_lookup": """SELECT l.row_id, l."Error_Number", t.title FROM labelled l LEFT JOIN types t ON t.number = l."Error_Number" """,
    "seed_summary_join": """SELECT row_id, coalesce(error_summary, 'nan') AS observed, coalesce(error_summary, '') AS intended FROM joined""",
    "similar_pairs": "SELECT i, j, round(sim, 6) AS sim FROM cosines WHERE sim > 0.35",
    "pair_counts": "SELECT i, j, round(sim, 6) AS sim, type_1, type_2, count_1, count_2 FROM counted",
    "remap_labels": 'SELECT row_id, "Error_Number", "Error_Type" FROM remapped',
    "surviving_types": "SELECT doc_id, letter, title FROM surviving",
    "response_join": """SELECT row_id, request_id, length("Content") % 9 <> 0 AS answered, coalesce(response, '') AS response FROM replied""",
    "passage_leaks": """SELECT DISTINCT doc_id, item_id FROM documents d JOIN (
        SELECT item_id, text FROM benchmark UNION ALL
        SELECT item_id * 10 + k + 1000000, array_to_string(string_split(text, ' ')[:k], ' ')
          FROM benchmark, (SELECT unnest(range(1, 7)) AS k)) b ON contains(d.text, b.text)""",
    "decontaminate": """SELECT row_id, "Content" FROM logs WHERE lower("Content") NOT IN (
      SELECT lower("Content") FROM wrong)""",
    "plan_closure": "SELECT from_type, to_type FROM closed",
    "doc_broadcast_join": f"""SELECT row_id, "Content" || {LF} || (SELECT document FROM document) AS text FROM wrong""",
    # aggregations
    "parsing_accuracy": f"""SELECT system, count(*) AS processed, count(*) FILTER (outcome = 'same') AS correct,
      {PERCENT.format("count(*) FILTER (outcome = 'same')", "count(*)")} AS accuracy FROM scored GROUP BY 1""",
    "coverage": "SELECT system, count(*) AS requested, count(response) AS processed FROM answers GROUP BY 1",
    "label_distribution": 'SELECT "Error_Type", count(*) AS rows FROM labelled GROUP BY 1',
    "number_distribution": 'SELECT "Error_Number", count(*) AS rows FROM labelled GROUP BY 1',
    "merge_effect": """SELECT coalesce(b.t, a.t) AS "Error_Type", coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after,
      coalesce(b.m, 0) AS moved
      FROM (SELECT old AS t, count(*) AS n, count(*) FILTER (old <> "Error_Type") AS m FROM remapped GROUP BY 1) b
      FULL JOIN (SELECT "Error_Type" AS t, count(*) AS n FROM remapped GROUP BY 1) a ON a.t = b.t""",
    "summary_overview": OVERVIEW,
    "seed_stats": """SELECT "Error_Number", count(*) AS seeds, count(*) FILTER (coalesce(error_summary, '') <> '') AS with_summary,
      count(*) FILTER (coalesce(error_summary, '') = '') AS without_summary FROM joined GROUP BY ROLLUP ("Error_Number")""",
    "selection_distribution": 'SELECT "Error_Number", count(*) AS seeds FROM slots WHERE slot < 3000 GROUP BY 1',
    "summary_corpus": f"""SELECT string_agg('- ' || error_summary || {LF} || {LF}, '' ORDER BY position) AS corpus FROM valid
      WHERE position <= (SELECT {SAMPLE_SIZE} FROM (SELECT count(*) AS n FROM valid))""",
    "augment_totals": """SELECT (SELECT count(*) FROM seeds) AS originals, (SELECT count(*) FROM variants) AS variants,
      (SELECT count(*) FROM seeds) + (SELECT count(*) FROM variants) AS total""",
    "strata": 'SELECT DISTINCT "Error_Number" FROM labelled',
    "failure_codes": 'SELECT "Error_Type", count(*) AS rows FROM parsed WHERE "Error_Number" = 0 GROUP BY 1',
    "grouping_accuracy": f"""SELECT system, count(*) AS rows, count(*) FILTER (p = g AND p = b) AS correct,
      {PERCENT.format("count(*) FILTER (p = g AND p = b)", "count(*)")} AS grouping_accuracy FROM (
        SELECT system, count(*) OVER (PARTITION BY system, "Prediction") AS p, count(*) OVER (PARTITION BY system, "EventTemplate") AS g,
          count(*) OVER (PARTITION BY system, "Prediction", "EventTemplate") AS b FROM scored) GROUP BY 1""",
    "template_inventory": 'SELECT system, count(*) AS rows, count(DISTINCT "EventTemplate") AS templates FROM logs GROUP BY 1',
    "inconsistent_templates": """SELECT system, "EventTemplate", count(DISTINCT "Prediction") AS predictions, count(*) AS rows
      FROM scored GROUP BY 1, 2 HAVING count(DISTINCT "Prediction") > 1""",
    # windows
    "stratified_shuffle": 'SELECT row_id, "Error_Number", turn AS rank FROM turns',
    "round_robin_seeds": 'SELECT row_id, "Error_Number", slot FROM slots WHERE slot < 3000',
    "dedup_keep_last": """SELECT seq, original_log, correct_template, error_summary FROM (SELECT *, row_number() OVER (
      PARTITION BY original_log, correct_template ORDER BY seq DESC) AS back FROM summaries) WHERE back = 1""",
    "reletter": """SELECT doc_id, number, CASE WHEN number <= 26 THEN chr(cast(64 + number AS int)) END AS letter, title FROM (
      SELECT doc_id, title, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS number FROM surviving)""",
    "running_accuracy": f"""SELECT system, batch_id, processed, correct, {PERCENT.format('correct', 'processed')} AS accuracy FROM (
      SELECT system, batch_id, cast(sum(n) OVER w AS bigint) AS processed, cast(sum(c) OVER w AS bigint) AS correct FROM (
        SELECT system, row_id // 4 AS batch_id, count(*) AS n, count(*) FILTER (outcome = 'same') AS c FROM scored GROUP BY 1, 2)
      WINDOW w AS (PARTITION BY system ORDER BY batch_id))""",
    "top_n_variants": "SELECT seed_id, cast(pos AS int) AS pos, input, output FROM variants WHERE pos < 2",
    "merge_target": "SELECT from_type, to_type, first_i, first_j FROM plan",
    # samples and limits
    "sample_rows": f'SELECT row_id, "Content" FROM logs ORDER BY {order("row_id")} LIMIT 500',
    "capped_sample": "SELECT seq, position FROM valid WHERE position <= 300",
    "max_samples": """SELECT origin, seed_id, input, output FROM (
      SELECT 'original' AS origin, seed_id, 0 AS place, "Original_Log" AS input, "Correct_Template" AS output FROM seeds
      UNION ALL SELECT 'variant', seed_id, pos + 1, input, output FROM variants) ORDER BY origin, seed_id, place LIMIT 20000""",
    "volume_cap": f"""SELECT seed_id, "Original_Log" FROM (SELECT *, row_number() OVER (ORDER BY {order('seed_id')}) AS r FROM seeds)
      WHERE r <= (SELECT count(*) FROM wrong)""",
    "frequent_types": """SELECT row_id, "Error_Type" FROM labelled WHERE "Error_Type" IN (
      SELECT "Error_Type" FROM labelled GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)""",
    # set operators
    "tuning_union": f"""SELECT 'original' AS origin, seed_id, 0 AS place, {TUNING} FROM seeds UNION ALL
      SELECT 'variant', seed_id, cast(pos + 1 AS int), {lit(fixed.INSTRUCTION)}, input, output FROM variants""",
    "topup_union": """SELECT seed_id, 0 AS round, cast(pos AS int) AS pos, input, output FROM variants UNION ALL
      SELECT seed_id, 1, 0, c || ' r1', CASE strategy WHEN 1 THEN t ELSE t || ' r1' END FROM first_lists
      WHERE len(v) < 3 AND kind % 2 = 0""",
    "distinct_variants": """SELECT seed_id, cast(pos AS int) AS pos, input, output FROM (
      SELECT *, row_number() OVER (PARTITION BY seed_id, input ORDER BY pos) AS k FROM variants) WHERE k = 1""",
    # embeddings and similarity
    "embed_text": """SELECT doc_id, letter, title || ' ' || description || CASE WHEN len(examples) > 0
      THEN ' ' || array_to_string(examples[1:2], ' ') ELSE '' END AS embed_text FROM blocks""",
    "embed_provider": """SELECT doc_id, letter, cast(length(t) AS double) AS chars,
      cast(length(t) - length(replace(t, ' ', '')) AS double) AS spaces FROM (
      SELECT doc_id, letter, title || ' ' || description || CASE WHEN len(examples) > 0
        THEN ' ' || array_to_string(examples[1:2], ' ') ELSE '' END AS t FROM blocks)""",
    "embed_attach": """SELECT vec_id AS pos, 'Type ' || (vec_id + 1) AS title, cast(len(embedding) AS int) AS dims,
      round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings""",
    "cosine_pairs": "SELECT i, j, round(sim, 6) AS sim FROM cosines WHERE sim IS NOT NULL",
    "lsh_pairs": "SELECT i, j, round(sim, 6) AS sim FROM cosines WHERE sim > 0.40",
    "near_copies": "SELECT i, j, round(sim, 6) AS sim FROM copied_cosines WHERE sim > 0.90",
    "threshold_sweep": " UNION ALL ".join(
        f"SELECT cast({t} AS double) AS threshold, count(*) FILTER (sim > {t}) AS pairs FROM cosines" for t in SWEEP
    ),
    # variant generation
    "assign_strategy": "SELECT seed_id, strategy FROM seeds",
    "topup_rounds": """SELECT seed_id, cast(u.n AS int) AS place, u.i AS input, u.o AS output FROM (
      SELECT seed_id, unnest(list_transform(w, lambda s, n: {'n': n, 'i': s.i, 'o': s.o})) AS u FROM round_lists)""",
    "substitute_variables": """SELECT seed_id, cast(place AS int) AS place, replace(replace(replace(
        'user #1 ' || string_split(template, ' ')[3] || ' value=#2 k=#3', '#1', v[1]), '#2', v[2]), '#3', v[3]) AS input,
      template AS output FROM refilled""",
    "slot_values": "SELECT system, template, slot, value, count(*) AS rows FROM observed_slots GROUP BY 1, 2, 3, 4",
    # streaming and the model step
    "stream_scoring": 'SELECT row_id, system, "Prediction", outcome FROM scored',
    "stream_accuracy": f"""SELECT system, count(*) AS processed, count(*) FILTER (outcome = 'same') AS correct,
      {PERCENT.format("count(*) FILTER (outcome = 'same')", "count(*)")} AS accuracy FROM scored GROUP BY 1""",
    "model_provider": f"""SELECT row_id, CASE WHEN NOT ends_with("Content", '7') THEN
        CASE WHEN row_id % 2 = 0 THEN '{len(fixed.ERROR_SYSTEM)}' ELSE '{len(fixed.CLASSIFY_SYSTEM)}' END
          || ' TEMPLATE: ' || upper("Content") END AS response,
      CASE WHEN ends_with("Content", '7') THEN 'no answer' END AS error FROM logs""",
}


def statements() -> dict[str, str]:
    return {name: statement(text) for name, text in SELECTS.items()}
