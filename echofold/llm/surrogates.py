"""Personal data replaced by surrogates, by DataFrame functions only.

Mentions are found by one pattern of alternatives. Each stands for one or more parts (a name:
a given name and a surname), and equal parts, whatever their spelling, are one entity: its
canonical form has no separators and one case. An entity's surrogate comes from a keyed hash
of that form and is of its kind: digits stay digits and letters letters of their script and
case, card numbers keep their check sum, addresses stay addresses, given names keep gender
and script. The same key gives the same surrogate everywhere, so mentions still refer to one
another. Two entities with one surrogate, or a surrogate that is itself an entity of the
texts, are told apart: all but the first are hashed again until no such case is left. A
mention then takes the letters and digits of its surrogate in its own separators and case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, text_of

#: Honorifics by gender; fixed values.
MALE = ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Г-н", "Господин", "Κύριος", "Κος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Г-жа", "Госпожа", "Κυρία", "Κα")
EITHER = ("Dr", "Prof", "Professor", "Doktor", "Docteur", "Доктор", "Профессор")
#: Words within a name that are no names themselves; fixed values.
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "la", "le", "du", "ten", "ter", "zu", "bin", "ibn", "al", "el", "y")
#: A letter with a capital or of a script without case, and what follows it: inner capitals, hyphens, apostrophes before a capital.
_FIRST = r"[\p{Lu}\p{Lt}\p{Lo}]"
_NAME = rf"{_FIRST}(?:\p{{M}}|-?\p{{L}}|['’]\p{{Lu}})+"
_INITIAL = r"\p{Lu}\."
_END = r"(?![\p{L}\p{N}\p{M}])"
_LABEL = r"(?:(?i:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)"
#: Kinds that begin where a word begins. A secret's mention has its label, which stays.
KINDS = {
    "secret": rf"{_LABEL}[^\s\"']{{8,}}|[0-9a-f]{{32,128}}{_END}|[0-9A-F]{{32,128}}{_END}|AKIA[0-9A-Z]{{16}}{_END}",
    "email": r"[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?\.){1,8}\p{L}{2,24}",
    "iban": rf"[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?{_END}(?<=\d[A-Z0-9 ]{{0,6}})",
    "card": r"(?<![.,-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-])",
    "ssn": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<!\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "mac": rf"[0-9a-fA-F]{{2}}(?:[:-][0-9a-fA-F]{{2}}){{5}}{_END}",
    "phone": r"(?<![.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])|(?<![\d.,-][ ])(?<![.,-])(?:0\d{2,4}[ ]\d{3,4}|\d{3}[ ]\d{3})[ ]\d{4}(?![ ]?\d|[.,-]\d)",
    "name": rf"(?:{'|'.join((*MALE, *FEMALE, *EITHER))})\.?(?:[ ]{_INITIAL})*[ ]{_NAME}{_END}(?:(?:[ ](?:{'|'.join(PARTICLES)}))*[ ](?:{_INITIAL}|{_NAME}{_END}))*",
}
_PHONES = r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)"
PATTERN = r"(?<![\p{L}\p{N}])(?:" + "|".join(KINDS.values()) + f")|{_PHONES}"
#: A text with none of these has no mention; the plain searches cost far less than the pattern.
HINT = "[0-9@=:]"
_VOWELS, _CONSONANTS = "aeiou", "bdfgklmnprstvz"
_CYR_VOWELS, _CYR_CONSONANTS = "аеиоу", "бвгдзклмнпрст"
_GREEK_VOWELS, _GREEK_CONSONANTS = "αεηιου", "βγδζθκλμνπρστφχ"
#: Scripts without case whose letters follow one another: name, first code point, letters taken; fixed values.
SCRIPTS = (("Hebrew", 0x5D0, 27), ("Arabic", 0x628, 19), ("Devanagari", 0x915, 37), ("Thai", 0xE01, 46), ("Georgian", 0x10D0, 33), ("Hiragana", 0x304B, 68), ("Katakana", 0x30AB, 68), ("Hangul", 0xAC00, 11_172), ("Han", 0x4E00, 20_902))
_NAMES = ("given_m", "given_f", "given", "surname")
#: Times that an entity is hashed again, each fourth of which gives names another syllable; characters of a part of a secret.
MOST_ATTEMPTS, CHUNK = 64, 256


def mentions(text: Column) -> Column:
    """The whole text's mentions, from left to right, without overlaps."""
    some = reduce(lambda a, h: a | text.contains(h + " ") | text.contains(h + ". "), (*MALE, *FEMALE, *EITHER), text.rlike(HINT))
    return F.when(some, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def is_personal(value: Column) -> Column:
    """Whether a mention stands for something: a number in the form of a card's has to have a card's check sum."""
    return ~value.rlike(f"^(?:{KINDS['card']})$") | (_luhn(F.regexp_replace(value, "[ -]", "")) == 0)


def kind_of(value: Column) -> Column:
    """The first kind whose pattern the whole mention fits."""
    out = F.lit("secret")
    for kind, p in reversed(list(KINDS.items())):
        out = F.when(value.rlike(f"^(?:{p}{'|' + _PHONES if kind == 'phone' else ''})$"), F.lit(kind)).otherwise(out)
    return out


def label_of(value: Column) -> Column:
    """What stands before a secret."""
    return F.regexp_extract(value, f"^({_LABEL})", 1)


def _chunks(value: Column) -> Column:
    """A secret's text in parts of bounded length, so that the work follows its length."""
    return F.regexp_extract_all(value, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _bare(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}\p{M}]", ""))


def _named_words(value: Column) -> Column:
    """The words of a name behind its honorific."""
    return F.split(F.regexp_replace(value, r"^\S+\s", ""), " ")


def parts_of(kind: Column, value: Column) -> Column:
    """array<struct<type, canon>> of a mention: a name's words, the last one its surname, a secret's chunks, else the whole."""
    secret = F.expr("substring(value, 1 + length(label))")
    bare = _bare(value)
    words = _named_words(value)
    honorific = lambda names: value.rlike("^(?:" + "|".join(names) + r")\.?\s")
    given = F.when(honorific(MALE), F.lit("given_m")).when(honorific(EITHER), F.lit("given")).otherwise(F.lit("given_f"))
    one = lambda t, c: F.struct(t.alias("type"), c.alias("canon"))
    plain = lambda w: F.lower(F.regexp_replace(w, "’", "'"))
    of_word = lambda w, i: F.when(w.rlike(rf"^(?:{'|'.join(PARTICLES)})$"), F.lit("particle")).when(w.rlike(rf"^{_INITIAL}$"), F.lit("initial")).when(i == F.size(words) - 1, F.lit("surname")).otherwise(given)
    named = F.transform(words, lambda w, i: one(of_word(w, i), plain(w)))
    canon = F.when(kind == "email", F.lower(value)).when(kind == "ip", value).when((kind == "phone") & value.startswith("+"), F.concat(F.lit("+"), bare)).otherwise(bare)
    return F.when(kind == "name", named).when(kind == "secret", F.transform(_chunks(secret), lambda c: one(F.lit("secret"), _bare(c)))).otherwise(F.array(one(kind, canon)))


def _nibbles(key: str, attempt: Column, kind: Column, canon: Column) -> Column:
    """Hash digits of an entity, enough for two numbers of 4 digits to each of its characters; the key is hashed in twice."""
    # a name of n syllables takes 2 * n numbers
    blocks = F.sequence(F.lit(0), F.expr("CAST((length(canon) + 6 + attempt div 2) div 16 AS INT)"))
    once = F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), canon), 256)
    return F.concat_ws("", F.transform(blocks, lambda i: F.sha2(F.concat_ws("|", F.lit(key), i.cast("string"), once), 512)))


def _number(stream: Column, i: Column, below: int) -> Column:
    return (F.conv(F.substring(stream, i * 8 + 1, F.lit(8)), 16, 10).cast("long") % below).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), n + 1, F.lit(1))


def _letter_at(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _spelled(stream: Column, canon: Column, hexed: Column) -> Column:
    """Character by character: a digit or letter of the same script and case; others stay."""
    lower, greek = "abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω"
    cyrillic = "абвгдежзиклмнопрстуфхцчшэюя"

    def one(c: Column, i: Column) -> Column:
        digit = _pick("0123456789", _number(stream, i, 10))
        letter = lambda a: F.when(c.rlike(r"^\p{Lu}"), F.upper(_pick(a, _number(stream, i, len(a))))).otherwise(_pick(a, _number(stream, i, len(a))))
        return (
            F.when(hexed & c.rlike("^[a-f]"), _pick("abcdef", _number(stream, i, 6)))
            .when(c.rlike(r"^\p{N}"), digit)
            .when(c.rlike(r"^\p{IsCyrillic}"), letter(cyrillic))
            .when(c.rlike(r"^\p{IsGreek}"), letter(greek))
            .when(c.rlike(r"^(?:\p{IsLatin}|\p{Lu}|\p{Ll})"), letter(lower))
            .otherwise(reduce(lambda rest, x: F.when(c.rlike(rf"^(?=\p{{L}})\p{{Is{x[0]}}}"), _letter_at(x[1] + _number(stream, i, x[2]))).otherwise(rest), SCRIPTS, c))
        )

    return F.array_join(F.transform(F.split(canon, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.when(c.cast("int") > 4, 1).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _surrogate(key: str, attempt: Column, kind: Column, canon: Column) -> Column:
    s = F.col("stream")
    at = lambda i: F.lit(i)
    spelled = _spelled(s, canon, (kind == "mac") | (kind == "secret") & canon.rlike("^[0-9a-f]+$"))
    # card numbers and international numbers keep their first digit; the last digit makes up for the difference, so a valid number gives a valid one
    body = F.expr("concat(substring(canon, 1, 1), substring(spelled, 2, length(spelled) - 2))")
    phone = F.when(canon.startswith("+"), F.concat(F.substring(canon, 1, 2), F.expr("substring(spelled, 3)"))).otherwise(F.col("spelled"))
    card = F.concat(body, ((_luhn(canon) - _luhn(F.concat(body, F.lit("0"))) + 10) % 10).cast("string"))
    ip = F.concat_ws(".", *((_number(s, at(i), 254) + 1).cast("string") for i in range(4)))
    top = F.regexp_extract(canon, r"\.(\p{L}+)$", 0)
    email = F.concat(F.expr("substring(spelled, 1, length(spelled) - length(regexp_extract(canon, '\\\\.(\\\\p{L}+)$', 0)))"), top)
    iban = F.concat(F.substring(canon, 1, 2), F.expr("substring(spelled, 3)"))

    def name(vowels: str, consonants: str, ending: Column) -> Column:
        syllables = F.transform(F.sequence(F.lit(0), F.lit(2) + F.expr("attempt div 4").cast("int")), lambda i: F.concat(_pick(consonants, _number(s, 2 * i, len(consonants))), _pick(vowels, _number(s, 2 * i + 1, len(vowels)))))
        return F.concat(F.array_join(syllables, ""), ending)

    end = lambda m, f, g, o: F.when(kind == "given_m", F.lit(m)).when(kind == "given_f", F.lit(f)).when(kind == "given", F.lit(g)).otherwise(F.lit(o))
    named = (
        F.when(canon.rlike(r"^\p{IsCyrillic}"), name(_CYR_VOWELS, _CYR_CONSONANTS, end("р", "на", "ль", "ко")))
        .when(canon.rlike(r"^\p{IsGreek}"), name(_GREEK_VOWELS, _GREEK_CONSONANTS, end("ς", "να", "ν", "δης")))
        .when(canon.rlike(r"^\p{IsLatin}"), name(_VOWELS, _CONSONANTS, end("rt", "na", "l", "s")))
        .otherwise(F.col("spelled"))
    )
    return F.when(kind == "card", card).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "email", email).when(kind == "iban", iban).when(kind.isin(*_NAMES), named).otherwise(F.col("spelled"))


def _hashed(entities: DataFrame, key: str) -> DataFrame:
    kind, canon = F.col("type"), F.col("canon")
    df = entities.withColumn("stream", _nibbles(key, F.col("attempt"), kind, canon))
    df = df.withColumn("spelled", _spelled(F.col("stream"), canon, (kind == "mac") | (kind == "secret") & canon.rlike("^[0-9a-f]+$")))
    return df.select("type", "canon", "attempt", _surrogate(key, F.col("attempt"), kind, canon).alias("surrogate"))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(type, canon, surrogate) for distinct (type, canon): no two alike in a type, none itself an entity of it."""
    known = stash(entities.select("type", "canon").distinct(), "entities")
    given = stash(_hashed(known.withColumn("attempt", F.lit(0)), key), "surrogates")
    for _ in range(MOST_ATTEMPTS):
        first = given.groupBy("type", "surrogate").agg(F.min_by("canon", F.struct("attempt", "canon")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        twice = given.join(first, ["type", "surrogate"]).where("canon <> first").select("type", "canon", "attempt")
        real = given.join(known.select("type", F.col("canon").alias("surrogate")), ["type", "surrogate"], "left_semi").select("type", "canon", "attempt")
        again = stash(twice.union(real).distinct(), "collisions")
        if again.isEmpty():
            return given.select("type", "canon", "surrogate")
        kept = given.join(again.select("type", "canon"), ["type", "canon"], "left_anti")
        given = stash(kept.unionByName(_hashed(again.withColumn("attempt", F.col("attempt") + 1), key)), "surrogates")
    raise ValueError(f"no distinct surrogates after {MOST_ATTEMPTS} attempts: a kind has more entities than spellings")


def _formatted(value: Column, surrogate: Column) -> Column:
    """The surrogate's letters and digits in the separators and case of the mention."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        own = c.rlike(r"^[\p{L}\p{N}]")
        new = F.substring(surrogate, acc["at"], F.lit(1))
        cased = F.when(c.rlike(r"^\p{Lu}"), F.upper(new)).otherwise(new)
        return F.struct(F.concat(acc["out"], F.when(own, cased).otherwise(c)).alias("out"), (acc["at"] + F.when(own, 1).otherwise(0)).alias("at"))

    return F.aggregate(F.split(value, ""), start, step, lambda acc: acc["out"])


def _cased(surrogate: Column, word: Column) -> Column:
    """A name's word in capitals if the mention's is, else with a capital; particles and initials as they are."""
    alone = word.rlike(rf"^(?:{'|'.join(PARTICLES)}|{_INITIAL})$")
    rest = F.substring(surrogate, F.lit(2), F.length(surrogate))
    return F.when(alone, surrogate).when((F.length(word) > 1) & (word == F.upper(word)), F.upper(surrogate)).otherwise(F.concat(F.upper(F.substring(surrogate, F.lit(1), F.lit(1))), rest))


def replacements(found: DataFrame, key: str) -> DataFrame:
    """(value, replacement) for the distinct mentions of ``found`` (value)."""
    kinds = stash(found.select("value").distinct().withColumn("kind", kind_of(F.col("value"))).withColumn("label", label_of(F.col("value"))).withColumn("parts", parts_of(F.col("kind"), F.col("value"))), "mentions")
    each = kinds.select("value", "kind", "label", F.posexplode("parts").alias("i", "part")).select("value", "kind", "label", "i", "part.type", "part.canon")
    own = F.col("type").isin("particle", "initial")
    table = assign(each.where(~own), key)
    # an initial stands for too little to be told apart: any letter of its script
    letter = F.regexp_replace(F.col("spelled"), r"\.$", "")
    alone = each.where(own).withColumn("attempt", F.lit(0)).withColumn("stream", _nibbles(key, F.col("attempt"), F.col("type"), F.col("canon"))).withColumn("spelled", _spelled(F.col("stream"), F.col("canon"), F.lit(False)))
    alone = alone.select("value", "kind", "label", "i", F.when(F.col("type") == "initial", F.concat(F.upper(letter), F.lit("."))).otherwise(F.col("canon")).alias("surrogate"))
    both = each.where(~own).join(table, ["type", "canon"]).select("value", "kind", "label", "i", "surrogate").unionByName(alone)
    joined = both.groupBy("value", "kind", "label").agg(F.array_sort(F.collect_list(F.struct("i", "surrogate"))).alias("parts"))
    texts = F.transform("parts", lambda p: p["surrogate"])
    honorific = F.regexp_extract("value", r"^\S+\s", 0)
    plain = lambda s: F.regexp_replace(s, r"[^\p{L}\p{N}\p{M}]", "")
    chunks = _chunks(F.expr("substring(value, 1 + length(label))"))
    secret = F.concat(F.col("label"), F.array_join(F.zip_with(chunks, texts, lambda c, s: _formatted(c, plain(s))), ""))
    named = F.concat(honorific, F.array_join(F.zip_with(texts, _named_words(F.col("value")), _cased), " "))
    new = F.when(F.col("kind") == "secret", secret).when(F.col("kind") == "name", named).when(F.col("kind") == "ip", F.get(texts, F.lit(0))).otherwise(_formatted(F.col("value"), plain(F.get(texts, F.lit(0)))))
    return joined.select("value", new.alias("replacement"))


def replace_personal_data(docs: DataFrame, *, key: str, text_col: str = "text", out_col: str | None = None, count_col: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text_col`` (or, with ``out_col``, there); ``count_col`` gets the number of mentions.

    Null and empty texts stay as they are, with 0 mentions. A text without mentions is not
    shuffled. Equal texts are treated once; each row keeps its other columns. Surrogates
    depend on ``key``, the entity and, where there was a collision, on the entities it met.
    """
    out_col = out_col or text_col
    # rows travel packed, so that no column of theirs meets one made here
    found = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[text_col].cast("string").alias("text"))
    # numbers that only look like cards' stay among the found, as the text is cut at them too
    found = found.withColumn("found", mentions(text_of("text"))).withColumn("text_id", F.unhex(F.md5(text_of("text"))))
    found = found.withColumn("n", F.size(F.filter("found", is_personal)).cast("long"))
    has = F.col("n") > 0
    texts = stash(found.where(has).select("text_id", "found").groupBy("text_id").agg(F.first("found").alias("found")), "texts-with-mentions")
    each = texts.select("text_id", F.posexplode("found").alias("i", "value"))
    table = stash(replacements(each.where(is_personal(F.col("value"))), key), "replacements")
    own = F.struct("i", F.coalesce("replacement", "value").alias("replacement"))
    new = each.join(table.hint("merge"), "value", "left").groupBy("text_id").agg(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["replacement"]).alias("new"))
    new = stash(new, "replacements-of-texts")
    pieces = F.split("text", PATTERN, -1)
    rebuilt = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("new"), i), F.lit("")))), "")
    changed = found.where(has).join(new.hint("merge"), "text_id").select("row", rebuilt.alias("out"), "n")
    same = found.where(~has).select("row", F.col("text").alias("out"), "n")
    columns = {c: F.col("row").getField(c) for c in docs.columns} | {out_col: F.col("out")} | ({count_col: F.col("n")} if count_col else {})
    return changed.unionByName(same).select(*(v.alias(k) for k, v in columns.items()))
