"""Surrogates for personal data (native).

Entities are found by pattern; each distinct entity gets one replacement of its own kind,
drawn from a keyed hash, and every mention of it, in whatever case or punctuation (names: not in
small letters, in which many are common words), gets that replacement in the mention's own format.  Kinds: e-mail addresses, IPv4 and IPv6
addresses, payment cards, phone numbers, social security numbers, IBANs, secrets (a name
such as ``token``, ``key`` or ``password`` followed by a value; case matters), and names of
persons after a form of address.  Replacements keep digits where digits were, letters
where letters were, the case of the mention, the validity of check digits (cards, IBANs,
which also keep their country), and for names the script (Latin, Cyrillic or Greek; names
in other scripts are not taken) and the gender that the form of address tells.

Coreference: given names and surnames are entities of their own, so "Mr Carl Brun" and
"Mr Brun" stay one person; a name found in a text is replaced wherever else it stands in
that text as a whole word; a given name whose form of address tells no gender takes the
one it has elsewhere in the corpus.

Collision checks: a replacement must not be an entity of the corpus itself, and no two
entities of a kind may share one.  Draws that fail are repeated with the next attempt, in
rounds over the few that are left, until none is left.  So distinct entities stay
distinct and equal ones equal.  Names, addresses and secrets get longer with the attempts,
and a secret that a draw leaves as it is (of signs alone) gets hexadecimal digits; kinds
of a fixed form could run out, so more than ``ROUNDS`` rounds are an error.

The key is the session's ``spark.docloom.pii.key``, if no other is given; the constant
here is for demonstrations.

Scale: only distinct entities are shuffled for the draws; texts are shuffled once, and
only those with an entity; equal texts are rebuilt once.

Edge cases: null text stays null; texts without entities are returned as they are; a null
doc_id is carried; repeated rows get equal results; an empty table gives an empty result;
other columns, whatever their names, are carried along (``n_entities`` and ``kinds`` are
replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docloom.storage import materialize

#: Forms of address and the gender they tell.  Fixed values.
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Господин", "г-н", "Κύριος", "Κύριε"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mademoiselle", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Госпожа", "г-жа", "Κυρία"),
    "n": ("Mx", "Dr", "Prof", "Professor", "Доктор"),
}
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_LETTER = r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}&&\p{%s}]"
#: Brun, Núñez-Díaz, McDonald, O'Neil, and in capitals; never the first part of a longer word.
_NAME = rf"(?:{_LETTER % 'Lu'}['’])?{_LETTER % 'Lu'}{_LETTER % 'Ll'}+(?:[-'’]?{_LETTER % 'Lu'}{_LETTER % 'Ll'}+)*(?!\p{{L}})"
_CAPITALS = rf"(?:{_LETTER % 'Lu'}['’])?{_LETTER % 'Lu'}{{2,}}(?:-{_LETTER % 'Lu'}{{2,}})*(?!\p{{L}})"
#: Of forms of address in capitals, those that are no other word.  Fixed values.
_LOUD = "|".join(t.upper() for t in ("Mr", "Mrs", "Herr", "Herrn", "Monsieur", "Señor", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Господин", "Госпожа"))

#: Kind -> pattern, in order of precedence at one place.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "secret": r"(?i:\b(?:api[_-]?key|secret|token|passw(?:or)?d|key)\b\"?\s{0,2}[:=]\s{0,2}[\"'])[^\"'\s]{6,}(?=[\"'])|(?i:\b(?:api[_-]?key|secret|token|passw(?:or)?d|key)\b\s{0,2}[:=]\s{0,2})[A-Za-z0-9+/_-]{16,}",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",
    "ip6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|::(?=[0-9A-Fa-f:]*\d)[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![\w:]|\.\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\d])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d\p{L}])(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d\p{L}])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d\p{L}.-])(?:1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])|(?<![\d\p{L}.-])0\d{1,4}[ /-]\d{3,4}[ -]?\d{3,4}(?![\d-])",
    "person": rf"(?<![\p{{L}}])(?:(?:{_TITLE})\.?[ \u00a0](?:{_NAME}(?:[ \u00a0]{_NAME}){{0,2}}|{_CAPITALS})|(?:{_LOUD})\.?[ \u00a0]{_CAPITALS}(?:[ \u00a0]{_CAPITALS})?)",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Syllables of made-up names; their endings tell gender.  Kept apart by script.
SYLLABLES = {
    "latin": ("ba", "ce", "di", "fo", "ga", "he", "ji", "ko", "lu", "ma", "ne", "pi", "ro", "sa", "tu", "ve"),
    "cyrillic": ("ба", "ве", "ги", "до", "жа", "зе", "ки", "ло", "му", "на", "пе", "ри", "со", "та", "ву", "ше"),
    "greek": ("βα", "γε", "δι", "ζο", "θα", "κε", "λι", "μο", "να", "πε", "ρι", "σο", "τα", "φε", "χι", "ψο"),
}
ENDINGS = {("latin", "m"): "ron", ("latin", "f"): "lina", ("latin", "n"): "ris", ("latin", "s"): "sen", ("cyrillic", "m"): "мир", ("cyrillic", "f"): "лина", ("cyrillic", "n"): "рис", ("cyrillic", "s"): "енко", ("greek", "m"): "νος", ("greek", "f"): "νη", ("greek", "n"): "ρις", ("greek", "s"): "ιδης"}
#: Letters that stand for letters of Han script.
_HAN = "".join(chr(0x4E00 + i) for i in range(512))
KEY, KEY_SETTING = "docloom-demonstration-key", "spark.docloom.pii.key"
#: Rounds of draws after which a kind must have run out of replacements.
ROUNDS = 64
#: Rows of a table of entities up to which it is sent to every executor.
SMALL_ROWS = 200_000


def kind_of(match: Column) -> Column:
    """The kind of a found mention: the first pattern that it fits as a whole."""
    out = F.lit("person")
    for kind in reversed([k for k in PATTERNS if k not in ("person", "secret")]):
        out = F.when(match.rlike(rf"\A(?:{PATTERNS[kind]})\z"), F.lit(kind)).otherwise(out)
    return F.when(match.rlike(rf"\A(?:{PATTERNS['email']})\z"), F.lit("email")).when(match.rlike(r"(?i)\A(?:api|secret|token|passw|key).*[:=]"), F.lit("secret")).otherwise(out)


def _parts(match: Column) -> Column:
    """A mention as an array of (lead, kind, surface): lead is kept, surface replaced."""
    kind = kind_of(match)
    whole = F.array(F.struct(F.lit("").alias("lead"), kind.alias("kind"), match.alias("surface")))
    opening = F.regexp_extract(match, r"(?i)\A[a-z_-]+\"?\s{0,2}[:=]\s{0,2}[\"']?", 0)
    secret = F.array(F.struct(opening.alias("lead"), F.lit("secret").alias("kind"), F.substring(match, F.length(opening) + 1, F.length(match)).alias("surface")))
    names = F.split(match, "[ \u00a0]")
    title = F.regexp_replace(F.element_at(names, 1), r"\.\z", "")
    told = lambda g: F.upper(title).isin(*[t.upper() for t in TITLES[g]])
    gender = F.when(told("m"), "m").when(told("f"), "f").otherwise("n")
    person = F.transform(
        F.slice(names, F.lit(2), F.size(names)),
        lambda name, i: F.struct(
            F.when(i == 0, F.concat(F.element_at(names, 1), F.lit(" "))).otherwise(F.lit(" ")).alias("lead"),
            F.concat(F.when(name.rlike(r"\A\p{IsCyrillic}"), F.lit("cyrillic_")).when(name.rlike(r"\A\p{IsGreek}"), F.lit("greek_")).otherwise(F.lit("latin_")), F.when(i == F.size(names) - 2, F.lit("s")).otherwise(gender)).alias("kind"),
            name.alias("surface"),
        ),
    )
    return F.when(kind == "person", person).when(kind == "secret", secret).otherwise(whole)


def canonical(kind: Column, surface: Column) -> Column:
    """What all mentions of an entity have in common."""
    compact = F.regexp_replace(surface, r"[^\p{L}\p{N}]", "")
    return F.when(kind.isin("card", "phone", "ssn", "iban"), F.upper(compact)).when(kind == "secret", surface).otherwise(F.lower(surface))


def _draw(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """A replacement in canonical form, from a keyed hash."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string"))
    bits = F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("+")), 256))  # 128 hex digits

    def number(at: Column, width: int) -> Column:
        return F.conv(F.substring(bits, at, width), 16, 10).cast("long")

    chars = F.split(canon, "")
    # a character for each of the canonical form's: digits for digits, letters for letters
    stream = F.transform(chars, lambda c, i: F.struct(c.alias("c"), F.conv(F.substring(F.sha2(F.concat(seed, (i.cast("string"))), 256), 1, 7), 16, 10).cast("long").alias("r")))
    alike = F.transform(
        stream,
        lambda x: F.when(x["c"].rlike(r"\A\p{Nd}\z"), (x["r"] % 10).cast("string")).when(x["c"].rlike(r"\A[a-f]\z"), F.substring(F.lit("abcdef"), (x["r"] % 6 + 1).cast("int"), F.lit(1))).when(x["c"].rlike(r"\A\p{Ll}\z"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (x["r"] % 26 + 1).cast("int"), F.lit(1))).when(x["c"].rlike(r"\A\p{Lu}\z"), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (x["r"] % 26 + 1).cast("int"), F.lit(1))).when(x["c"].rlike(r"\A\p{IsHan}\z"), F.substring(F.lit(_HAN), (x["r"] % len(_HAN) + 1).cast("int"), F.lit(1))).when(x["c"].rlike(r"\A\p{L}\z"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (x["r"] % 26 + 1).cast("int"), F.lit(1))).otherwise(x["c"]),
    )
    same = F.array_join(alike, "")
    # the first digit tells a card's network and a phone's country
    same = F.when(kind.isin("card", "phone"), F.concat(F.substring(canon, F.lit(1), F.lit(1)), F.substring(same, F.lit(2), F.length(same)))).otherwise(same)
    grown = F.substring(bits, F.lit(65), F.least(F.expr("attempt div 4"), F.lit(64)).cast("int"))
    signs = F.substring(F.repeat(bits, 8), F.lit(1), F.greatest(F.length(canon), F.lit(8)))
    same = F.when(kind == "secret", F.concat(F.when(same == canon, signs).otherwise(same), grown)).otherwise(same)
    octets = F.concat_ws(".", (number(F.lit(1), 7) % 222 + 1).cast("string"), *[(number(F.lit(at), 7) % 254 + 1).cast("string") for at in (9, 17, 25)])

    def syllables(script: str, count: int) -> Column:
        table = F.array(*[F.lit(s) for s in SYLLABLES[script]])
        return F.concat(*[F.element_at(table, (number(F.lit(1 + 3 * n), 2) % 16 + 1).cast("int")) for n in range(count)])

    # a name grows a syllable for every second attempt, so its domain is never exhausted
    out = same
    for (script, gender), ending in ENDINGS.items():
        longer = F.array_join(F.transform(F.sequence(F.lit(0), F.least(F.expr("attempt div 2"), F.lit(8))), lambda i: F.when(i == 0, F.lit("")).otherwise(F.element_at(F.array(*[F.lit(s) for s in SYLLABLES[script]]), (F.conv(F.substring(bits, 40 + i * 2, F.lit(2)), 16, 10).cast("long") % 16 + 1).cast("int")))), "")
        out = F.when(kind == f"{script}_{gender}", F.concat(syllables(script, 3), longer, F.lit(ending))).otherwise(out)
    local = F.concat(syllables("latin", 4), F.lit("."), (number(F.lit(40), 9) % 1000000000).cast("string"), grown)
    out = F.when(kind == "email", F.concat(local, F.lit("@example."), F.element_at(F.array(*[F.lit(t) for t in ("com", "net", "org")]), (number(F.lit(60), 4) % 3 + 1).cast("int")))).otherwise(out)
    return F.when(kind == "ip", octets).when(kind == "card", _checked(same, canon)).when(kind == "iban", _checked_iban(same, canon)).otherwise(out)


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo ten."""
    values = F.reverse(F.split(digits, ""))
    return F.aggregate(
        F.transform(values, lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")).otherwise(c.cast("int"))),
        F.lit(0), lambda a, x: (a + x).cast("int"),
    ) % 10


def _mod97(text: Column) -> Column:
    """A string of digits and letters (A is 10) as a number modulo 97."""
    digits = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike(r"\A[A-Z]\z"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda a, c: ((a * 10 + c.cast("int")) % 97).cast("int"))


def _checked_iban(drawn: Column, canon: Column) -> Column:
    """Keep the country; give valid check digits if the original has them."""
    country, body = F.substring(canon, 1, 2), F.substring(drawn, F.lit(5), F.length(drawn))
    check = F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    valid = _mod97(F.concat(F.substring(canon, F.lit(5), F.length(canon)), F.substring(canon, 1, 4))) == 1
    return F.concat(country, F.when(valid, check).otherwise(F.substring(drawn, 3, 2)), body)


def _checked(drawn: Column, canon: Column) -> Column:
    """Give the drawn number a valid check digit if the original has one."""
    body = F.concat(F.substring(drawn, F.lit(1), F.length(drawn) - 1), F.lit("0"))
    digit = (10 - _luhn(body)) % 10
    return F.when(_luhn(canon) == 0, F.concat(F.substring(drawn, F.lit(1), F.length(drawn) - 1), digit.cast("string"))).otherwise(drawn)


def resolve(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``entities`` (kind, canon), distinct -> kind, canon, drawn, all checked."""
    real = materialize(entities.select("kind", "canon"), "pii-entities")
    open_, done, attempt = real, None, 0
    while True:
        tried = open_.withColumn("attempt", F.lit(attempt))
        tried = materialize(tried.withColumn("drawn", _draw(F.col("kind"), F.col("canon"), F.col("attempt"), key)).drop("attempt"), "pii-drawn")
        free = tried.join(real.select("kind", F.col("canon").alias("drawn")), ["kind", "drawn"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "drawn"), ["kind", "drawn"], "left_anti")
        won = materialize(free.groupBy("kind", "drawn").agg(F.min("canon").alias("canon")).select("kind", "canon", "drawn"), "pii-won")
        done = won if done is None else done.unionAll(won)
        open_ = materialize(open_.join(won, ["kind", "canon"], "left_anti"), "pii-open")
        if open_.isEmpty():
            return done
        attempt += 1
        if attempt >= ROUNDS:
            raise RuntimeError(f"no free replacements after {ROUNDS} rounds: " + ", ".join(r.kind for r in open_.select("kind").distinct().limit(8).collect()))


def _formatted(kind: Column, surface: Column, drawn: Column) -> Column:
    """The replacement in the mention's format: its separators, its case."""
    # a separator of the mention stays in its place, other characters are taken in turn
    kept = F.split(surface, "")
    taken = F.transform(kept, lambda c, i: F.when(c.rlike(r"\A[\p{L}\p{N}]\z"), F.substring(drawn, F.size(F.filter(F.slice(kept, F.lit(1), i + 1), lambda d: d.rlike(r"\A[\p{L}\p{N}]\z"))), F.lit(1))).otherwise(c))
    spaced = F.array_join(taken, "")
    cased = F.when(surface == F.upper(surface), F.upper(drawn)).when(surface.rlike(r"\A\p{Lu}") & kind.contains("_"), F.initcap(drawn)).otherwise(drawn)
    return F.when(kind.isin("card", "phone", "ssn", "iban"), spaced).when(kind.isin("ip", "secret"), drawn).otherwise(cased)


def _with_later_mentions(runs: Column, last: Column) -> Column:
    """``runs`` and the text after them, in which names of persons that a form of address
    has told are mentions wherever they stand as whole words."""
    persons = F.filter(runs, lambda r: r["kind"].contains("_"))
    words = r"\p{L}+(?:[-'’]\p{Lu}(?:\p{Ll}+|\p{Lu}+))*|[^\p{L}]+"

    def expanded(b: Column) -> Column:
        def pieces(text: Column) -> Column:
            return F.transform(F.regexp_extract_all(text, F.lit(words), F.lit(0)), lambda w: told(b, w))

        def told(b: Column, w: Column) -> Column:
            # as told, or in capitals; in small letters many a name is a common word
            at = F.when(w.rlike(r"\A\p{Lu}"), F.greatest(F.array_position(b["names"], w), F.array_position(b["capitals"], w))).otherwise(0).cast("int")
            kind = F.when(at > 0, F.get(b["kinds"], at - 1))
            return F.struct(F.when(at > 0, "").otherwise(w).alias("lead"), kind.alias("kind"), F.when(at > 0, w).alias("surface"))

        each = F.transform(runs, lambda r: F.concat(pieces(r["lead"]), F.array(F.struct(F.lit("").alias("lead"), r["kind"].alias("kind"), r["surface"].alias("surface")))))
        return F.concat(F.flatten(each), pieces(last))

    bound = F.struct(F.transform(persons, lambda r: r["surface"]).alias("names"), F.transform(persons, lambda r: F.upper(r["surface"])).alias("capitals"), F.transform(persons, lambda r: r["kind"]).alias("kinds"))
    plain = F.concat(runs, F.array(F.struct(last.alias("lead"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("surface"))))
    return F.when(F.size(persons) > 0, F.transform(F.array(bound), expanded)[0]).otherwise(plain)


def _gendered(rows: DataFrame) -> DataFrame:
    """Give given names without a gender the one they have elsewhere."""
    known = rows.where(r"kind rlike '_[mf]$'").groupBy(F.substring_index("kind", "_", 1).alias("_script"), F.col("canon").alias("_canon")).agg(F.min("kind").alias("_told"))
    known = materialize(known, "pii-genders")
    known = F.broadcast(known) if known.count() <= SMALL_ROWS else known
    same = F.col("kind").endswith("_n") & (F.substring_index("kind", "_", 1) == F.col("_script")) & (F.col("canon") == F.col("_canon"))
    return rows.join(known, same, "left").withColumn("kind", F.coalesce("_told", "kind")).drop("_script", "_canon", "_told")


def replace_entities(docs: DataFrame, key: str | None = None) -> DataFrame:
    """All columns, with ``text`` rewritten, ``n_entities`` and ``kinds`` (kinds found)."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    made = ("n_entities", "kinds")
    found = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text", F.md5(F.encode("text", "UTF-8")).alias("_key"))
    texts = keyed.where(F.col("text").rlike(PATTERN)).select("_key", "text").withColumn("_m", found).where(F.size("_m") > 0)
    between = F.split("text", PATTERN, -1)
    # runs of (text before the mention + its lead, kind, surface), and the text after the last
    runs = F.flatten(F.zip_with(F.slice(between, F.lit(1), F.size("_m")), "_m", lambda before, m: F.transform(_parts(m), lambda p, i: F.struct(F.when(i == 0, F.concat(before, p["lead"])).otherwise(p["lead"]).alias("lead"), p["kind"].alias("kind"), p["surface"].alias("surface")))))
    mentions = texts.dropDuplicates(["_key"]).select("_key", F.inline(F.array(F.struct(runs.alias("runs"), F.element_at(between, -1).alias("last")))))
    mentions = materialize(mentions.select("_key", _with_later_mentions(F.col("runs"), F.col("last")).alias("runs")), "pii-mentions")
    rows = mentions.select("_key", F.posexplode("runs").alias("at", "r")).select("_key", "at", "r.lead", "r.kind", "r.surface", canonical(F.col("r.kind"), F.col("r.surface")).alias("canon"))
    rows = materialize(_gendered(rows), "pii-rows")
    entities = rows.where("kind IS NOT NULL").select("kind", "canon").distinct()
    drawn = resolve(entities, key)
    drawn = materialize(drawn, "pii-resolved")
    replaced = F.concat("lead", F.coalesce(_formatted(F.col("kind"), F.col("surface"), F.col("drawn")), F.lit("")))
    written = rows.join(F.broadcast(drawn) if drawn.count() <= SMALL_ROWS else drawn, ["kind", "canon"], "left").select("_key", F.struct("at", replaced.alias("s"), "kind").alias("p"))
    rebuilt = written.groupBy("_key").agg(F.sort_array(F.collect_list("p")).alias("p"))
    told = F.filter(F.transform("p", lambda x: x["kind"]), lambda k: k.isNotNull())
    rebuilt = rebuilt.select("_key", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("_text"), F.size(told).alias("_n"), told.alias("_kinds"))
    joined = keyed.join(rebuilt, "_key", "left")
    return joined.select(
        *[F.coalesce("_text", "_row.text").alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns if c not in made],
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_entities"),
        F.array_sort(F.array_distinct(F.coalesce("_kinds", F.array().cast("array<string>")))).alias("kinds"),
    )
