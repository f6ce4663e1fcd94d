"""Personal data: patterns on hard texts, disclosing terms against a plain count of all texts, the rewritten texts."""

import math
import re
from collections import defaultdict

from tidecast.llm import sanitise

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        doubled = [int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def _base(text):
    """(start, place, kind, end, entity, words beside it) of a text."""
    out = []
    for place, (kind, pattern) in enumerate(PLAIN.items()):
        found = [(m.start(), m.end()) for m in re.finditer(pattern, text)]
        for k, (start, end) in enumerate(found):
            if not _valid(kind, text[start:end]):
                continue
            low, high = found[k - 1][1] if k else 0, found[k + 1][0] if k + 1 < len(found) else len(text)
            left, right = text[max(low, start - 64):start], text[end:min(high, end + 64)]
            left = re.sub(r"^[^\W\d_]+", "", left) if start - low > 64 else left
            right = re.sub(r"[^\W\d_]+$", "", right) if high - end > 64 else right
            left = re.sub(r"[^\W\d_]+$", "", left) if text[start].isalpha() else left
            right = re.sub(r"^[^\W\d_]+", "", right) if text[end - 1].isalpha() else right
            value = re.sub("[^0-9]", "", text[start:end]) if kind in ("card", "phone") else text[start:end].lower()
            out.append((start, place, kind, end, f"{kind}:{value}", {w for w in re.findall(r"[^\W\d_]+", f"{left}\n{right}".lower()) if len(w) >= 3}))
    return sorted(out, key=lambda s: s[:2])


def _plain(texts, generalise=0.95, remove=0.99, least=3):
    """[(start, kind, end, action)] of each text."""
    texts = [t or "" for t in texts]
    every = {t: _base(t) for t in texts}
    n = sum(t != "" for t in every)
    with_entity, both, with_term = defaultdict(set), defaultdict(set), defaultdict(set)
    for text, spans in every.items():
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            with_term[w].add(text)
        for *_, entity, near in spans:
            with_entity[entity].add(text)
            for w in near:
                both[entity, w].add(text)
    share = {}
    for (entity, w), found in both.items():
        if len(found) >= least and len(with_entity[entity]) < n:
            told = 1 + math.log2(len(found) / len(with_term[w])) / math.log2(n / len(with_entity[entity]))
            if round(told, 9) >= generalise:
                share[w] = max(share.get(w, 0), round(told, 9))
    out = []
    for text in texts:
        spans = [(s, p, k, e, "replace") for s, p, k, e, *_ in every[text]]
        spans += [(m.start(), 4, "term", m.end(), "remove" if share[m.group().lower()] >= remove else "generalise")
                  for m in re.finditer(r"[^\W\d_]+", text) if m.group().lower() in share and all(s >= m.end() or e <= m.start() for s, _, _, e, _ in spans)]
        out.append([(s, k, e, a) for s, _, k, e, a in sorted(spans)])
    return out


HARD = [
    None, "", "no data here, 1.2.3 and 12-34", "a@b a@b.c_d@e.f.g @x.y é.x@y.z", "1.2.3.4.5.6.7.8 256.1.1.1 0255.000.1.1 1.1.1.0300",
    "4539 1488 0343 6467, 4539148803436468 4539-1488-0343-6467-12 79927398713 00000000000000", "+1 (555) 123-4567 +123456789 + 1 555 +44.20.7946.0958 ++1555123456789012",
    "mail 1.2.3.4@5.6.7.8 +1.2.3.4.5.6.7.8.9.0", "𝄞𝄞 x@y.zz 𝄞 10.0.0.1 ß", "a" * 2_000 + "@" + "b" * 2_000, "9" * 2_000, "+" + "1 " * 2_000, "x@y.z " * 300 + "10.9.8.7 " * 300,
    "line one\n+1 555 123\n4567 end\tq@w.e\r\n"]


def _rows(spark, texts):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, text_key string, start int")
    return {r["id"]: r for r in sanitise.sanitise(docs.repartition(5)).collect()}


def _spans(row):
    return [(s["start"], s["kind"], s["end"], s["action"]) for s in row["spans"]]


def test_entities_of_hard_texts_equal_the_patterns(spark):
    got = _rows(spark, HARD)
    assert {k: _spans(r) for k, r in got.items()} == dict(enumerate(_plain(HARD)))
    assert got[1]["sanitised"] == got[0]["sanitised"] == "" and got[2]["sanitised"] == HARD[2]
    assert got[8]["sanitised"] == "𝄞𝄞 [email] 𝄞 [ip] ß"
    # The address, the number and the address in it are one span of text.
    assert got[7]["sanitised"].startswith("mail [email]") and "+1.2" not in got[7]["sanitised"]


def test_runs_of_any_length_are_read_once(spark):
    long = ["a" * 300_000, "9" * 300_000, "+" + "1 " * 150_000, "a." * 100_000 + "@" + "b" * 100_000, "1.2.3.4 " * 20_000, "x" * 200_000 + "@y.z"]
    got = _rows(spark, long)
    assert [len(got[k]["spans"]) for k in range(6)] == [0, 0, 0, 0, 20_000, 1]
    assert _spans(got[4])[-1] == (159_992, "ip", 159_999, "replace") and _spans(got[5]) == [(0, "email", 200_004, "replace")]


def test_terms_that_reveal_an_entity_are_removed_or_generalised(spark):
    filler = [f"plain words number {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]} about Corvin and others" for k in range(60)]
    known = [f"Report {c}: contact Zebulon Quirke at z.quirke@corp.example or later, seldom" for c in "abcdefghijkl"] + ["Zebulon Quirke was seen", "Corvin calls +1 555 123 4567"]
    texts = [*filler, *known, known[0], known[0], known[12], *[f"éq{c}@y.z and {c}" for c in ("x", "x", "x")], "éqx@y.z too"]
    got = _rows(spark, texts)
    want = _plain(texts)
    assert {k: _spans(r) for k, r in got.items()} == dict(enumerate(want))
    assert {a for spans in want for _, k, _, a in spans if k == "term"} == {"remove", "generalise"}
    assert got[72]["sanitised"] == "[email-term] [email-term] was seen" and got[0]["sanitised"] == filler[0] and got[73]["sanitised"] == "Corvin calls [phone]"
    assert "Quirke" not in got[60]["sanitised"] and "[email]" in got[60]["sanitised"]


def test_entity_in_every_text_and_empty_table(spark):
    every = [f"Same {c} to x@y.z now" for c in "abcd"]
    assert [_spans(r) for _, r in sorted(_rows(spark, every).items())] == _plain(every)
    assert _rows(spark, []) == {}
