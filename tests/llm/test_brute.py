"""Queries over the smallest tables against plain versions, and names of columns that clash."""

import hashlib
import re
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltagrid.llm import bpe, bwt, cnn, jaccard, langid, media, mixing, pii, queries, rules, toxicity
from deltagrid.llm.common import labelled_texts, remainder, table

DIR = "/root/testdata/sf0.001"


def texts(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, DIR, "documents").select("doc_id", "text").collect()}


# ---- 2: the same rules in plain Python


def feistel(values, radix, kind, key):
    h = len(values) // 2
    a, b, ra, rb = values[:h], values[h:], radix[:h], radix[h:]
    for k in range(pii.ROUNDS):
        joined = ",".join(map(str, b))
        digest = lambda n: hashlib.sha256(f"{key}|{kind}|{k}|{n}|{joined}".encode()).hexdigest()  # noqa: B023, E731
        number = lambda i: int(digest(i // 8)[i % 8 * 8 : i % 8 * 8 + 8], 16)  # noqa: B023, E731
        a, b, ra, rb = b, [(x + number(i)) % ra[i] for i, x in enumerate(a)], rb, ra
    return a + b


def spelled(s, kind, key, hexadecimal=True):
    if hexadecimal and re.fullmatch("[0-9a-f]{12,}", s):
        return "".join(f"{v:x}" for v in feistel([int(c, 16) for c in s], [16] * len(s), kind, key))
    base = lambda c: 48 if c in "0123456789" else 97 if "a" <= c <= "z" else 65 if "A" <= c <= "Z" else None
    new = feistel([0 if base(c) is None else ord(c) - base(c) for c in s], [1 if base(c) is None else 10 if base(c) == 48 else 26 for c in s], kind, key)
    return "".join(c if base(c) is None else chr(v + base(c)) for v, c in zip(new, s, strict=True))


def luhn(body):
    total = sum(int(c) if i % 2 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(body)))
    return str((10 - total % 10) % 10)


def mod97(s):
    return int("".join(c if c.isdigit() else str(ord(c) - 55) for c in s)) % 97


def filled(shape, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def replacement(m, kind, key):
    if kind == "email":
        stem, end = re.fullmatch(r"(.*?)(\.[A-Za-z]+)", m).groups() if m.count(".") == 1 else re.fullmatch(r"(.*)(\.[A-Za-z]+)", m).groups()
        return spelled(stem, "email", key, False) + end
    if kind == "key":
        head = re.match(r"AKIA|ASIA|gh[pos]_|sk-", m)[0]
        return head + spelled(m[len(head) :], "key", key)
    if kind == "assigned":
        value = re.search(r"[=:] ?[\"']?(.+)$", m)[1]
        return m[: len(m) - len(value)] + spelled(value, "assigned", key)
    if kind == "ipv4":
        octets = [int(x) for x in m.split(".")]
        return ".".join(map(str, feistel(octets, [256] * 4, "ipv4", key))) if max(octets) < 256 and not re.search(r"(?:^|\.)0\d", m) else None
    if kind == "ssn":
        a, g, s = (int(x) for x in m.split("-"))
        if not (0 < a < 900 and a != 666 and g and s):
            return None
        v = feistel([a - 2 if a > 666 else a - 1, g - 1, s - 1], [898, 99, 9999], "ssn", key)
        return f"{v[0] + 2 if v[0] >= 665 else v[0] + 1:03d}-{v[1] + 1:02d}-{v[2] + 1:04d}"
    if kind == "card":
        d = re.sub(r"\D", "", m)
        inner = "".join(map(str, feistel([int(c) for c in d[1:-1]], [10] * (len(d) - 2), "card", key)))
        return filled(m, d[0] + inner + luhn(d[0] + inner)) if luhn(d[:-1]) == d[-1] else None
    if kind == "iban":
        s = m.replace(" ", "")
        new = spelled(s[4:], "iban", key, False)
        out = iter(s[:2] + f"{98 - mod97(new + s[:2] + '00'):02d}" + new)
        return "".join(c if c == " " else next(out) for c in m) if mod97(s[4:] + s[:4]) == 1 else None
    if kind == "phone":
        head = (re.match(r"\+\d{1,3}(?=[ .\-(])[ .\-]?|\+\d", m) or [""])[0]
        d = [int(c) for c in m[len(head) :] if c.isdigit()]
        first = d[0] >= 2
        v = feistel([d[0] - 2 if first else d[0], *d[1:]], [8 if first else 2, *[10] * (len(d) - 1)], "phone", key)
        return head + filled(m[len(head) :], "".join(map(str, [v[0] + 2 if first else v[0], *v[1:]])))
    parts = [int(x) for x in re.split(r"[\-/.]", m)]
    iso, month_first = re.match(r"\d{4}-", m), "/" in m and parts[0] <= 12
    try:
        day = date(*parts) if iso else date(parts[2], parts[0], parts[1]) if month_first else date(parts[2], parts[1], parts[0])
    except ValueError:
        return None
    n = (day - date(1800, 1, 1)).days
    if not 0 <= n < pii.DAYS:
        return None
    v = feistel([n // pii.MINOR, n % pii.MINOR], [pii.MAJOR, pii.MINOR], "date", key)
    new = date(1800, 1, 1) + timedelta(v[0] * pii.MINOR + v[1])
    return new.strftime("%Y-%m-%d" if iso else "%m/%d/%Y" if month_first else "%d/%m/%Y" if "/" in m else "%d.%m.%Y")


def readings(text, kind):
    """The longest reading at each place that begins with the form and whose check digits are right."""
    form, least = pii.FORMS[kind]
    found = set()
    for m in re.finditer(form.replace("++", "+"), text):
        whole = m[1]
        for n in range(len(whole), least - 1, -1):
            cut = whole[:n]
            if re.fullmatch("[0-9A-Z]", cut[-1]) and not re.match("[0-9A-Z]", whole[n : n + 1] or " "):
                s = re.sub(r"[ \-]", "", cut)
                if len(s) >= least and (mod97(s[4:] + s[:4]) == 1 if kind == "iban" else luhn(s[:-1]) == s[-1]):
                    found.add(cut)
                    break
    before, after = (r"(?<![\d\-])", r"(?!\d)") if kind == "card" else (r"\b", r"\b")
    return f"{before}(?:{'|'.join(sorted(found, key=lambda s: (-len(s), s)))}){after}" if found else "(?!)"


def protected(text, key):
    if not text or not re.search("[@0-9=:]", text):
        return text, []
    patterns = {k: readings(text, k) if k in pii.FORMS else p.replace("++@", "+@") for k, p in pii.KINDS.items()}
    kinds = []

    def read(m):
        kind = next(k for k, p in pii.KINDS.items() if re.fullmatch(p.replace("++@", "+@"), m[0], re.ASCII))
        new = replacement(m[0], kind, key)
        if new is not None:
            kinds.append(kind)
        return m[0] if new is None else new

    return re.sub("|".join(f"(?:{p})" for p in patterns.values()), read, text, flags=re.ASCII), kinds


def test_pii_query_equals_brute_force(spark):
    got = {r["doc_id"]: r for r in queries.op2_pii(spark, DIR).collect()}
    key, seen = queries.secret(spark), 0
    for i, t in texts(spark).items():
        new, kinds = protected(t, key)
        assert (got[i]["text"], list(got[i]["pii_kinds"]), got[i]["n_pii"]) == (new, kinds, len(kinds))
        seen += len(kinds)
    assert seen > 20


def test_pii_of_an_empty_table(spark):
    assert pii.protect(table(spark, DIR, "documents").where("false"), "k").count() == 0


# ---- 4, 6, 10: the query's scores from its model by the plainest means


def test_language_query_equals_brute_force(spark):
    docs = table(spark, DIR, "documents")
    seen = labelled_texts(docs.select("doc_id", "text"), docs.select("doc_id", "lang").where(remainder("doc_id", 4) != 2), "doc_id", "lang", rows=800)
    model = langid.train([t for t, _ in seen], [g for _, g in seen])
    a, got = np.exp(model["trans"].astype(float)), {r["doc_id"]: r for r in queries.op4_langid(spark, DIR).collect()}
    for i, t in texts(spark).items():
        words = langid.WORDS.findall((t or "").lower())
        if not words:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        e = np.array([model["weights"][langid.features(w, model["lexicon"])].astype(float).sum(0) for w in words])
        x = np.exp(e - e.max(1, keepdims=True))
        f, b = [x[0] / x[0].sum()], [np.ones(len(a))]
        for k in range(1, len(x)):
            v = f[-1] @ a * x[k]
            f.append(v / v.sum())
        for k in range(len(x) - 1, 0, -1):
            v = (x[k] * b[-1]) @ a.T
            b.append(v / v.sum())
        post = np.array(f) * np.array(b[::-1])
        mean = (post / post.sum(1, keepdims=True)).mean(0)
        assert got[i]["lang_pred"] == model["langs"][mean.argmax()] and abs(got[i]["score"] - mean.max()) < 1e-3


def test_toxicity_query_equals_brute_force(spark):
    docs = table(spark, DIR, "documents").select("doc_id", "text")
    seen = labelled_texts(docs, table(spark, DIR, "labels").where(remainder("doc_id", 3) != 1), "doc_id", "toxic", rows=4000)
    counts = np.zeros(toxicity.LETTERS**toxicity.ORDER, np.int64)
    for t in texts(spark).values():
        c = [0] * (toxicity.ORDER - 1) + [toxicity.code(x) for x in (t or "").lower()] + [0]
        for k in range(len(c) - toxicity.ORDER + 1) if t else ():
            at = 0
            for x in c[k : k + toxicity.ORDER]:
                at = at * toxicity.LETTERS + x
            counts[at] += 1
    counted = toxicity.language_model(docs)
    inner = np.arange(len(counts)).reshape((toxicity.LETTERS,) * toxicity.ORDER)[1:, 1:, 1:, 1:].ravel()
    assert (counted[inner] == counts[inner]).all()  # runs within texts; how many boundaries stand between texts is the query's own
    model = toxicity.train(counted, [t for t, _ in seen], [y for _, y in seen])
    got = {r["doc_id"]: r["score"] for r in queries.op6_toxicity(spark, DIR).collect()}
    channel = toxicity.Channel(counted)
    for i, t in texts(spark).items():
        low, found = (t or "").lower(), set()
        tokens = low.split()
        for m in toxicity.SPACED.finditer(low):
            tokens += channel.path(m[0]).split()
        for token in tokens:
            words = toxicity.PLAIN.findall(token)
            for core in toxicity.cores(token):
                words += channel.path(core).split()
            found |= {f for w in words for f in toxicity.features(w)}
        if "constant" in model:
            assert got[i] == model["constant"]
        else:
            z = model["bias"] + sum(model["weights"][k] for f, k in model["known"].items() if f in found)
            assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-5


def test_quality_query_equals_brute_force(spark):
    from .test_operators import slow_score

    docs = table(spark, DIR, "documents").select("doc_id", "text")
    seen = labelled_texts(docs, table(spark, DIR, "labels").where(remainder("doc_id", 5) != 0), "doc_id", "quality", rows=1500)
    model = cnn.train([t for t, _ in seen], [y for _, y in seen])
    got = {r["doc_id"]: r["score"] for r in queries.op10_quality(spark, DIR).collect()}
    short = {i: t for i, t in texts(spark).items() if len(t or "") < 1500}
    assert len(short) > 50 and all(abs(got[i] - (slow_score(model, t) if "constant" not in model else model["constant"])) < 1e-3 for i, t in short.items())


# ---- 7: the verdict from the votes


def test_verdicts_follow_from_the_votes(spark):
    rows = rules.apply_rules(table(spark, DIR, "documents").select("doc_id", "text")).collect()
    from collections import Counter

    names = [f"vote_{r}" for r in rules.RULES]
    share, model = rules.fit(sorted(Counter(tuple(r[n] for n in names) for r in rows).items()))
    for r in rows:
        good, bad = share, 1 - share
        for n, t in zip(names, model, strict=True):
            good, bad = good * t["good"][r[n] + 1], bad * t["bad"][r[n] + 1]
        assert abs(r["p_good"] - good / (good + bad)) < 1e-9
        assert r["kept"] == (not (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and r["p_good"] >= 0.5)


# ---- names that clash

CORPUS = ["alpha beta gamma delta. " * 20, "alpha beta gamma delta. " * 20, None, "", "x"]
OPERATORS = {
    "bpe": (lambda d: bpe.encode(d, queries.VOCABULARY), ["ids"]),
    "pii": (lambda d: pii.protect(d, "k"), ["n_pii", "pii_kinds", "_any", "_pii"]),
    "jaccard": (lambda d: jaccard.join(d), ["id", "n", "digest", "node", "keys", "bits", "t", "row", "k", "comp", "component_id", "class_id"]),
    "deduplicate": (lambda d: jaccard.deduplicate(d), ["_row", "row", "id", "component", "component_id", "n"]),
    "langid": (lambda d: langid.predict(d, langid.train(["a b", "c d"], ["x", "y"])), ["lang_pred", "score"]),
    "words": (lambda d: langid.label_words(d, langid.train(["a b", "c d"], ["x", "y"])), ["words"]),
    "mixing": (lambda d: mixing.mix(d), ["size", "source_size", "target", "copies", "ord", "bucket", "of", "row", "tie", "rank", "rank0", "cell_size", "first", "taken", "_order", "n"]),
    "repeated": (lambda d: mixing.repeated(mixing.mix(d)), ["row", "col", "_copy"]),
    "toxicity": (lambda d: toxicity.classify(d, {"constant": 0.5}), ["score"]),
    "rules": (lambda d: rules.apply_rules(d), ["n_words", "n_lines", "kept", "p_good", "base_failed", "vote_symbols", "_t", "_words", "_lines", "_windows", "_places"]),
    "kept": (lambda d: rules.kept_rows(d), ["_row", "kept", "n_words", "vote_lines"]),
    "media": (lambda d: media.sniff(d.withColumn("b", F.col("text").cast("binary")), "b"), ["media_type", "media_items", "media_hits", "media_was_wrong"]),
    "carve": (lambda d: media.carve(media.sniff(d.withColumn("b", F.col("text").cast("binary")), "b"), "b"), ["_item", "item_type", "item_start", "item_bytes"]),
    "bwt": (lambda d: bwt.remove(d), ["id", "digest", "t", "n", "start", "key", "piece", "h", "hot", "name", "n_bytes"]),
    "cnn": (lambda d: cnn.classify(d, {"constant": 0.5}), ["score"]),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_names_of_other_columns_never_matter(spark, name):
    run, names = OPERATORS[name]
    plain = spark.createDataFrame([(i, t, "s" if i % 2 else None) for i, t in enumerate(CORPUS)], "doc_id bigint, text string, source string")
    want = run(plain)
    outputs = {c.lower() for c in want.columns}
    rows = lambda d, cols: sorted(repr([r[c] for c in cols]) for r in d.select(*[F.col(f"`{c}`") for c in cols]).collect())
    expected = rows(want, want.columns)
    clashing = plain
    for n in names:
        clashing = clashing.withColumn(n.upper(), F.lit("clash"))
    got = run(clashing)
    assert len({c.lower() for c in got.columns}) == len(got.columns) and outputs <= {c.lower() for c in got.columns}
    assert rows(got, want.columns) == expected
    for n in names:  # an input column that is no output stays as it was, where others pass through
        if n.lower() not in outputs and n.upper() in got.columns:
            assert {r[0] for r in got.select(f"`{n.upper()}`").collect()} <= {"clash"}
