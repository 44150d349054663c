import re

from pyspark.sql import functions as F

from echofold.llm.surrogates import KINDS, _luhn, assign, replace_personal_data

KEY = "k"


def run(spark, texts, key=KEY):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, r.n) for r in replace_personal_data(df, key=key, count_col="n").orderBy("doc_id").collect()]


def test_kinds_formats_and_coreference(spark):
    texts = [
        "Mrs. Anna Smith met Mr Smith. Mail A.B@mail7.example.com or a.b@mail7.example.com, +1 (017) 555-7713 and +1 017 555 7713",
        'card 4111 1111 1111 1111, 4111111111111111 ip 10.2.3.4 v4.0. 3. token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end',
        "SSN 123-45-6789; DE89 3704 0044 0532 0130 00; 00:1b:44:11:3a:b7 password: hunter22x",
        "Г-жа Анна Иванова и Г-н Иванов",
    ]
    out = run(spark, texts)
    a = re.fullmatch(r"Mrs\. ([A-Z]\w+) ([A-Z]\w+) met Mr ([A-Z]\w+)\. Mail (\S+) or (\S+), (\+1 \(\d{3}\) \d{3}-\d{4}) and (\+1 \d{3} \d{3} \d{4})", out[0][0])
    assert a and a[2] == a[3] != "Smith" and a[1] != "Anna" and a[1].endswith("na")
    assert a[4].lower() == a[5] != "a.b@mail7.example.com" and a[4][:1].isupper() and a[5].endswith(".com")
    assert re.sub(r"\D", "", a[6]) == re.sub(r"\D", "", a[7]) != "10175557713"
    b = re.fullmatch(r'card (\d{4} \d{4} \d{4} \d{4}), (\d{16}) ip (\d+\.\d+\.\d+\.\d+) v4\.0\. 3\. token = "([0-9a-f]{40})" end', out[1][0])
    assert b and b[1].replace(" ", "") == b[2] != "4111111111111111" and all(0 < int(x) < 255 for x in b[3].split("."))
    assert spark.range(1).select(_luhn(F.lit(b[2]))).first()[0] == 0
    assert re.fullmatch(r"SSN \d{3}-\d{2}-\d{4}; DE\d{2}( \d{4}){4} \d\d; [0-9a-f]{2}(:[0-9a-f]{2}){5} password: \w{9}", out[2][0])
    assert re.fullmatch(r"Г-жа [А-Я][а-я]+на [А-Я][а-я]+ко и Г-н [А-Я][а-я]+ко", out[3][0]) and "Иванов" not in out[3][0]
    assert [n for _, n in out] == [6, 4, 4, 2]
    assert run(spark, texts) == out and run(spark, texts, "other")[0] != out[0]


def test_names_of_any_words_and_scripts(spark):
    out = [t for t, _ in run(spark, [
        "Mrs. Anna Maria Smith met Mr McDonald and Mr O'Brien. Dr. Anna Weber, Herr Ludwig van der Berg; Mr SMITH",
        "Ms J. R. Smith-Jones's book, Mr D’Angelo", "Mr Γιώργος Παπαδόπουλος", "Mr משה כהן", "Mr 金明 and Ms 김민수", "Dr Smith",
    ])]
    a = re.fullmatch(r"Mrs\. ([A-Z][a-z]+na) ([A-Z][a-z]+na) ([A-Z][a-z]+s) met Mr ([A-Z][a-z]+s) and Mr ([A-Z][a-z]+s)\. Dr\. ([A-Z][a-z]+l) ([A-Z][a-z]+s), Herr ([A-Z][a-z]+rt) van der ([A-Z][a-z]+s); Mr ([A-Z]+)", out[0])
    assert a and a[10] == a[3].upper() and len(set(a.groups())) == 10 and not re.search("Anna|Maria|Smith|Donald|Brien|Weber|Ludwig|Berg", out[0])
    assert re.fullmatch(r"Ms [A-Z]\. [A-Z]\. [A-Z][a-z]+s's book, Mr [A-Z][a-z]+s", out[1])
    assert re.fullmatch(r"Mr [Α-Ω][α-ως]+ [Α-Ω][α-ω]+δης", out[2]) and re.fullmatch(r"Mr [א-ת]{3} [א-ת]{3}", out[3])
    assert re.fullmatch(r"Mr [一-龥]{2} and Ms [가-힣]{3}", out[4]) and out[5] == "Dr " + a[3]
    assert not set(re.findall(r"\w+", " ".join(out[2:5]))) & {"Γιώργος", "Παπαδόπουλος", "משה", "כהן", "金明", "김민수"}


def test_spaced_numbers(spark):
    out = run(spark, ["call 020 7946 0958 or 555 123 4567", "the rows 1 200 300 4000 and 12.555 123 4567"])
    assert re.fullmatch(r"call \d{3} \d{4} \d{4} or \d{3} \d{3} \d{4}", out[0][0]) and out[0][1] == 2 and "7946" not in out[0][0] and out[1][1] == 0


def test_long_secrets_take_time_in_proportion(spark):
    import time

    body = "".join(chr(97 + i * i % 23) + ("-" if i % 7 == 0 else "") for i in range(60_000))
    began = time.time()
    (text, n), (other, _) = run(spark, ["key: password=" + body + " end", "password=" + body])
    assert time.time() - began < 60 and n == 1 and text == "key: " + other + " end" and len(other) == len(body) + 9
    assert [i for i, c in enumerate(other) if c == "-"] == [i for i, c in enumerate("password=" + body) if c == "-"] and body[:20] not in text


def test_more_names_than_short_spellings(spark):
    from pyspark.sql import functions as F

    df = spark.range(400_000).select(F.lit("surname").alias("type"), F.concat(F.lit("n"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("canon"))
    r = assign(df, KEY).agg(F.count("*").alias("n"), F.count_distinct("surrogate").alias("d")).first()
    assert r.n == r.d == 400_000


def test_against_the_same_rules_in_python(spark):
    """Phones and e-mail addresses by a twin in Python: the keyed hash, spelled out, in the mention's own form."""
    import hashlib

    def stream(kind, canon):
        once = hashlib.sha256("|".join([KEY, kind, "0", canon]).encode()).hexdigest()
        return "".join(hashlib.sha512("|".join([KEY, str(i), once]).encode()).hexdigest() for i in range((len(canon) + 6) // 16 + 1))

    def spelled(kind, canon):
        s = stream(kind, canon)
        at = lambda i: int(s[8 * i : 8 * i + 8], 16)
        return "".join("0123456789"[at(i) % 10] if c.isdigit() else "abcdefghijklmnopqrstuvwxyz"[at(i) % 26] if c.isalpha() else c for i, c in enumerate(canon))

    mails, phones = [f"Ab{i}.c@mail{i}.example.com" for i in range(30)], [f"55{i % 10}-10{i % 10}-{1000 + i}" for i in range(30)]
    got = run(spark, [f"x {m} y {p} z" for m, p in zip(mails, phones, strict=True)])
    for m, p, (text, n) in zip(mails, phones, got, strict=True):
        mail = spelled("email", m.lower())[: -len(".com")] + ".com"
        mail = "".join(c.upper() if o.isupper() else c for c, o in zip(mail, m, strict=True))
        digits = iter(spelled("phone", p.replace("-", "")))
        phone = "".join(c if c == "-" else next(digits) for c in p)
        assert (text, n) == (f"x {mail} y {phone} z", 2)


def test_what_is_none_stays(spark):
    texts = [None, "", "GNU General Public License, version 3. CC BY-NC 4.0. In 2024, 1.2.3 and 12-34", "Mr and Mrs", "a @ b", "(x) 1,234,567.89 100%"]
    assert run(spark, texts) == [(t, 0) for t in texts]


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10


def test_numbers_without_a_cards_check_sum_stay(spark):
    out = run(spark, ["order 9807915762804490 and 1219 5381 1253 5716", "order 9807915762804490 paid by 4845168114407329", "4111-1111-1111-1111"])
    assert out[0] == ("order 9807915762804490 and 1219 5381 1253 5716", 0)
    assert out[1][1] == 1 and (m := re.fullmatch(r"order 9807915762804490 paid by (\d{16})", out[1][0])) and m[1] != "4845168114407329" and luhn(m[1]) == 0
    assert out[2][1] == 1 and out[2][0] != "4111-1111-1111-1111"


def test_no_original_is_left_in_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    new = {r.doc_id: r for r in replace_personal_data(docs, key=KEY, count_col="n_mentions").collect()}
    for r in docs.collect():
        n = new[r.doc_id]
        secrets = re.findall(r"\w[\w.]*@mail\d+\.example\.com|\b\d{16}\b|\+1 \(\d{3}\) 555-\d{4}|\b(?:\d{1,3}\.){3}\d{1,3}\b|\b[0-9a-fA-F]{40}\b", r.text)
        secrets = [s for s in secrets if not re.fullmatch(r"\d{16}", s) or luhn(s) == 0]
        assert len(n.text.split()) == len(r.text.split()) and n.n_mentions == len(secrets) and not any(s in n.text for s in secrets)
        if not secrets:
            assert n.text == r.text


def test_entities_stay_distinct_though_their_space_is_small(spark):
    names = [f"x{a}{b}" for a in "ab" for b in "cdefghij"]
    df = spark.createDataFrame([("ssn", f"{i:02}") for i in range(40)] + [("given_f", n) for n in names], "type string, canon string")
    rows = assign(df, KEY).collect()
    for kind in ("ssn", "given_f"):
        own = [(r.canon, r.surrogate) for r in rows if r.type == kind]
        assert len({s for _, s in own}) == len(own) == {"ssn": 40, "given_f": 16}[kind]
        assert not {s for _, s in own} & {c for c, _ in own}


def test_repeats_hot_values_and_clashing_columns(spark):
    rows = [(i, "call +1 (017) 555-7713", "x", 1, "n") for i in range(50)] + [(None, "call +1 (017) 555-7713", None, 1, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string, text_id int, new string")
    out = replace_personal_data(df, key=KEY).collect()
    assert len(out) == 51 and len({r.text for r in out}) == 1 and out[0].__fields__ == ["doc_id", "text", "found", "text_id", "new"] and out[0].new == "n"
    assert replace_personal_data(df.limit(0), key=KEY).count() == 0
    other = replace_personal_data(df.limit(1), key=KEY, out_col="safe", count_col="n").first()
    assert other.text.endswith("7713") and not other.safe.endswith("7713") and other.n == 1
    assert list(KINDS)[0] == "secret"


def test_a_very_long_text(spark):
    text = "word 10.1.2.3 " * 20_000
    out, n = run(spark, [text])[0]
    assert n == 20_000 and "10.1.2.3" not in out and out.count("word") == 20_000
