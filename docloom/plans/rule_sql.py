"""Questions made from a table's rows, and the rule tables as SQL over them.

The oracles of the classifiers: every rule list becomes a CASE of SQL here, written from
the tables of ``rules`` and independent of the column expressions there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docloom.functions import rules, text

#: What a row's question begins with, is about and ends with, dealt by its id.
OPENINGS = ("", "Tell me more about ", "Can you tell me more about: ", "What does ", "please explain ", "Who is ", "Who are ", "Summarize ", "How do we focus on ", "Why did ", "“", "(", "Overview of ", "We Face ", "what is the ")
SUBJECTS = (
    *[a for _, aliases in rules.OVERVIEW_ALIASES for a in aliases], *[h for _, hints, *_ in rules.ITEM_RULES for h in hints], *[h for hs in rules.SEARCH_ITEM.values() for h in hs], *rules.SEARCH_NUMERIC, *rules.SEARCH_EXECUTIVE,
    *rules.SEARCH_RISK, *rules.ANSWER_NARRATIVE, *rules.RISK_ENDINGS, "Dana Whitfield", "the Directors", "employees and revenue per share", "the results of 2016", "Risks Related to Our Suppliers and Partners", "nothing in particular", "Intense Competition", "straße and maße",
)
ENDINGS = ("?", "", ".", " mean?", "”?", ")", " in detail, with all of the reasons that were given", " of the  company ")


def questions(docs: DataFrame) -> DataFrame:
    """query_id, question: one for each document, about its first letters now and then."""
    pick = lambda values, of: F.get(F.array(*[F.lit(v) for v in values]), F.expr(f"cast({of} % {len(values)} as int)"))
    more = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" "), F.substring(F.coalesce("text", F.lit("")), 1, 40))).otherwise(F.lit(""))
    question = F.concat(pick(OPENINGS, "doc_id"), pick(SUBJECTS, f"(doc_id div {len(OPENINGS)})"), pick(ENDINGS, "(doc_id div 3)"), more)
    return docs.select(F.col("doc_id").alias("query_id"), question.alias("question"))


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


QUESTIONS = (
    f"q AS (SELECT doc_id AS query_id, {listed(OPENINGS)}[doc_id % {len(OPENINGS)} + 1] || {listed(SUBJECTS)}[doc_id // {len(OPENINGS)} % {len(SUBJECTS)} + 1] || {listed(ENDINGS)}[doc_id // 3 % {len(ENDINGS)} + 1]"
    " || CASE WHEN doc_id % 5 = 0 THEN ' ' || substr(coalesce(text, ''), 1, 40) ELSE '' END AS question FROM documents)"
)


def collapsed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def folded(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def words(x: str) -> str:
    return f"regexp_extract_all({folded(x)}, '[a-z0-9]+')"


def key(x: str) -> str:
    return rf"regexp_replace({collapsed(folded(x))}, '^[ ?.\n\t]+|[ ?.\n\t]+$', '', 'g')"


def has(x: str, hints) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(h)})" for h in dict.fromkeys(hints)) + ")"


def begins(x: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {quoted(p)})" for p in prefixes) + ")"


def shares(x: str, hints) -> str:
    return f"list_has_any({x}, {listed(hints)})"


def _peeled() -> str:
    bare = collapsed(r"regexp_replace(regexp_replace(" + collapsed("a") + r", '^[\s:;,\-]+', ''), '[\s:;,\-?.!]+$', '')")
    wrapped = r"""'^(".*"|''.*''|“.*”|‘.*’|\(.*\)|\[.*\])$'"""
    asked, about = r"'(?i)^(?:can you tell me more about|tell me more about|please explain|explain|describe|summarize)\s*:?\s*(.+)$'", r"'(?i)^(?:what can you tell me about|what does)\s+(.+)$'"
    once = f"[CASE WHEN length(b) >= 2 AND regexp_matches(b, {wrapped}) THEN substr(b, 2, length(b) - 2) WHEN regexp_extract(b, {asked}, 1) <> '' THEN regexp_extract(b, {asked}, 1) WHEN regexp_extract(b, {about}, 1) <> '' THEN regexp_extract(b, {about}, 1) ELSE b END for b in [{bare}]][1]"
    return f"nullif(list_reduce(list_prepend(question, ['', '', '', '', '', '', '', '', '', '']), lambda a, x: {once}), '')"


def _titled(x: str) -> str:
    """Of a list of words."""
    bare = rf"""[regexp_replace(w, '^[.,;:()\[\]{{}}"'']+|[.,;:()\[\]{{}}"'']+$', '', 'g') for w in {x}]"""
    real = f"[w for w in {bare} if w <> '' and not list_contains({listed(rules.CONNECTORS)}, {folded('w')})]"
    capitals = rf"len([w for w in s if regexp_matches(w, '^\p{{Lu}}')])"
    return f"[len(s) >= 3 AND {capitals} >= greatest(3, len(s) - 1) for s in [{real}]][1]"


def risk_heading(x: str) -> str:
    """Whether a column has the form of a risk heading."""
    lower = r"len([w for w in ws if regexp_matches(w, '\p{Ll}') and not regexp_matches(w, '\p{Lu}')])"
    rule = (
        rf"CASE WHEN line = '' OR len(ws) NOT BETWEEN 3 AND 30 OR regexp_matches(line, '\b(2015|2016|2017|2018|2019)\b') OR suffix(line, '.') OR {begins('low', rules.ASKING_PREFIXES)} THEN FALSE"
        f" WHEN starts_with(low, 'risks related to ') THEN TRUE WHEN len(ws) >= 5 AND (starts_with(low, 'we are subject to ') OR starts_with(low, 'we face risks related to ')) THEN TRUE"
        f" WHEN starts_with(low, 'our ') AND contains(low, ' risk') AND len(ws) <= 16 THEN {_titled('ws')} WHEN starts_with(low, 'we face ') AND len(ws) <= 12 THEN {_titled('ws')}"
        f" ELSE {lower} >= 2 AND NOT starts_with(line, 'We ') END"
    )
    for name, value in (("ws", "string_split(line, ' ')"), ("low", folded("line")), ("line", collapsed(x))):
        rule = f"[{rule} for {name} in [{value}]][1]"
    return rule


_ALIASES = rules._aliases()
_OVERVIEW = "CASE reference_key " + " ".join(f"WHEN {quoted(k)} THEN {quoted(item)}" for k, (item, _) in _ALIASES.items()) + " END"
_EXPLICIT = "CASE " + " ".join(f"WHEN qkey = {quoted(item.lower())} OR {has('qkey', hints)} THEN {quoted(item)}" for item, hints, *_ in rules.ITEM_RULES) + " END"
_NAMES_RISK = rf"({begins('{0}', rules.RISK_PREFIXES)} OR contains({{0}}, 'subject us to') AND contains({{0}}, ' risk') OR regexp_matches({{0}}, '\bwe face [a-z]|\bwe are subject to [a-z]') OR {has('{0}', rules.RISK_ENDINGS)})"
_KEYWORDS = f"list_filter(list_distinct({words('question')}), lambda w: NOT list_contains({listed(text.STOPWORDS)}, w))"
_COUPLED = " || ".join(f"CASE WHEN list_contains(k, {quoted(a)}) AND NOT list_contains(k, {quoted(b)}) THEN [{quoted(b)}] ELSE [] END" for x, y in text.COUPLED for a, b in ((x, y), (y, x)))
_RISK = "(contains(low, 'item 1a') OR (list_contains(kw, 'risk') AND list_contains(kw, 'factors') OR contains(low, 'risk factors')) AND NOT contains(low, 'item 7a'))"
_ITEM_5 = next(h for item, h, *_ in rules.ITEM_RULES if item == rules.ITEM_5)
_ITEMS = ", ".join(f"CASE WHEN {rule} THEN {quoted(item)} END" for item, rule in (
    (rules.ITEM_1A, _RISK),
    (rules.ITEM_1, f"(contains(low, 'item 1') OR {shares('kw', rules.ANSWER_BUSINESS)} AND NOT {shares('kw', rules.ANSWER_PROPERTIES)}) AND NOT {_RISK}"),
    (rules.ITEM_2, f"contains(low, 'item 2') OR {shares('kw', rules.ANSWER_PROPERTIES)}"), (rules.ITEM_3, f"contains(low, 'item 3') OR {shares('kw', rules.ANSWER_LEGAL)}"), (rules.ITEM_5, has("low", _ITEM_5)),
    (rules.ITEM_7A, f"{has('low', ('item 7a', 'quantitative and qualitative disclosures about market risk'))} OR {shares('kw', rules.ANSWER_MARKET)} AND NOT {has('low', ('item 1a', 'item 5'))}"),
    (rules.ITEM_8, shares("kw", rules.ANSWER_ITEM_8)),
))
_N_WORDS = f"len(string_split({collapsed('question')}, ' '))"
_SEARCH = (
    f"CASE WHEN {has('low', rules.SEARCH_NUMERIC)} THEN 'numeric_table' WHEN {begins('low', ('who is ', 'who are '))} OR {has('low', rules.SEARCH_EXECUTIVE)} THEN 'entity_lookup' WHEN overview IS NOT NULL THEN 'section_overview'"
    f" WHEN explicit = {quoted(rules.ITEM_1A)} AND {has('low', rules.SUMMARY_WORDS)} THEN 'narrative_explainer' " + " ".join(f"WHEN explicit = {quoted(item)} THEN {quoted(intent)}" for item, _, intent, *_ in rules.ITEM_RULES)
    + rf" WHEN qkey <> '' AND ({_NAMES_RISK.format(folded(collapsed('qkey')))} OR {has('qkey', rules.SEARCH_RISK)}) OR {_N_WORDS} >= 8 AND regexp_matches(question, '^\p{{Lu}}') THEN 'heading_lookup'"
    f" WHEN {has('low', [h for hs in rules.SEARCH_ITEM.values() for h in hs] + ['management', 'results of operations', 'liquidity'])} THEN 'narrative_explainer' ELSE 'general_lookup' END"
)
_ANSWER = (
    rf"CASE WHEN {has('low', rules.ANSWER_NUMERIC)} OR regexp_matches(low, '\b20[0-9]{{2}}\b') THEN 'numeric_table' WHEN overview IS NOT NULL THEN 'section_overview'"
    f" WHEN list_contains(items, {quoted(rules.ITEM_1A)}) THEN CASE WHEN {has('low', rules.SUMMARY_WORDS)} THEN 'narrative_explainer' ELSE 'heading_lookup' END WHEN {begins('low', ('who is ', 'who are '))} THEN 'entity_lookup'"
    f" WHEN contains(low, 'selected consolidated financial data') THEN 'numeric_table' WHEN {shares('kw', rules.ANSWER_EXECUTIVE)} THEN 'entity_lookup' WHEN list_contains(items, {quoted(rules.ITEM_7A)}) THEN 'narrative_explainer'"
    f" WHEN trim(low) <> '' AND ({_NAMES_RISK.format(folded(collapsed('trim(low)')))} OR {has('low', ('risk factor', 'could harm our business', 'could adversely affect our business', 'may adversely affect our business'))}) THEN 'heading_lookup'"
    f" WHEN NOT ({shares('kw', rules.ANSWER_MARKET)} OR contains(low, 'item 7a')) AND {shares('kw', rules.ANSWER_RISK)} AND {_N_WORDS} >= 6 THEN 'heading_lookup'"
    f" WHEN {shares('kw', rules.ANSWER_BUSINESS + rules.ANSWER_PROPERTIES + rules.ANSWER_LEGAL + rules.ANSWER_MARKET + rules.ANSWER_ITEM_8)} OR {has('low', rules.ANSWER_NARRATIVE)} THEN 'narrative_explainer' ELSE 'general_lookup' END"
)
#: Tables that end in ``told``: query_id, question, low, qkey, kw, reference, overview,
#: explicit, items, search_intent, answer_intent.
TOLD = f"""{QUESTIONS},
    a AS MATERIALIZED (SELECT query_id, question, {folded('question')} AS low, {key('question')} AS qkey, {_peeled()} AS reference, (SELECT k || {_COUPLED} FROM (SELECT {_KEYWORDS} AS k)) AS kw FROM q),
    b AS (SELECT *, array_to_string({words('coalesce(reference, question)')}, ' ') AS reference_key, {_EXPLICIT} AS explicit FROM a),
    c AS (SELECT *, {_OVERVIEW} AS overview FROM b),
    d AS (SELECT *, CASE WHEN overview IS NOT NULL THEN [overview] ELSE list_filter([{_ITEMS}], lambda i: i IS NOT NULL) END AS items FROM c),
    told AS MATERIALIZED (SELECT *, {_SEARCH} AS search_intent, {_ANSWER} AS answer_intent FROM d)"""




RISK_HEADING = f"SELECT query_id, CASE WHEN {risk_heading('reference')} THEN {collapsed('reference')} WHEN {risk_heading('bare')} THEN {collapsed('bare')} END AS heading FROM (SELECT query_id, reference, regexp_replace({collapsed('question')}, '^[?.! ]+|[?.! ]+$', '', 'g') AS bare FROM told)"
