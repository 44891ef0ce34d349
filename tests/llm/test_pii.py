"""Surrogates in texts that are put together from known entities in many spellings: what is replaced by what is told here
without the patterns of the operator."""

import random
import re
from collections import defaultdict

import pytest

from corpusloom.llm import pii


def luhn(body):
    d = [int(x) for x in body + "0"][::-1]
    return str(-sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10)


GIVEN = {"Anna": "f", "Susan": "f", "John": "m", "Luca": "m", "Mehmet": "m", "Ingrid": "f", "Élodie": "f", "Noa": "f"}
SURNAMES = ["Keller", "O'Brien", "Smith-Jones", "Müller", "García", "Li", "Vandenberghe"]


def person(rng):
    return rng.choice(sorted(GIVEN)), rng.choice(SURNAMES)


def spellings(rng, kind, who):
    """(text, part that is the entity as replaced) of one way to write an entity."""
    if kind == "name":
        given, surname = who
        title = rng.choice(["Mrs", "Ms.", "Frau", "Madame"] if GIVEN[given] == "f" else ["Mr.", "Herr", "Monsieur"])
        return rng.choice([f"{title} {given} {surname}", f"Dr. {given} {surname}", f"{given} {surname}", f"{title} {surname}", surname, f"Prof {given.upper()} {surname.upper()}"])
    if kind == "phone":
        a, b, c = who[:3], who[3:6], who[6:]
        return rng.choice([f"+1 {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"1-{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"+1.{a}.{b}.{c}"])
    if kind == "card":
        return rng.choice([who, " ".join(who[k : k + 4] for k in range(0, 16, 4)), "-".join(who[k : k + 4] for k in range(0, 16, 4))]) if len(who) == 16 else rng.choice([who, f"{who[:4]} {who[4:10]} {who[10:]}"])
    if kind == "email":
        return rng.choice([who, who.upper()])
    if kind == "secret":
        return rng.choice([f'token = "{who}"', f"api_key={who}", f'password: "{who}"'])
    return who


def shape(x):
    return re.sub("[0-9]", "0", x)


def make(rng):
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    pick = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    pool = {
        "name": [(g, s) for g in sorted(GIVEN) for s in SURNAMES], "phone": ["2" + d(9) for _ in range(12)],
        "card": [x + luhn(x) for x in ["4" + d(14) for _ in range(6)] + ["37" + d(12) for _ in range(3)]],
        "email": [f"{pick(rng.randint(1, 12), 'abcxyz')}{d(1)}@{pick(5, 'mnop')}.{rng.choice(['com', 'co.uk', 'de'])}" for _ in range(12)],
        "ip": [f"10.{rng.randint(0, 9)}.0.{k}" for k in range(4)] + [f"192.168.1.{k}" for k in range(4)] + [f"8.8.{k}.4" for k in range(4)] + ["172.20.1.1", "127.0.0.1"],
        "ssn": [f"{d(3)}-{d(2)}-{d(4)}" for _ in range(5)],
        "secret": [pick(20, "0123456789abcdef") for _ in range(3)] + ["AKIA" + pick(16, "ABCDEFGH234567") for _ in range(3)] + [pick(30, "abcXYZ012_") + "7" for _ in range(3)],
    }
    docs = []
    for _ in range(120):
        pieces = []
        for _ in range(rng.randint(0, 14)):
            if rng.random() < 0.4:
                pieces.append((None, None, rng.choice(["plain words here", "version 4.0.1 of 2024", "call 12345", "naïve façade", "1234567812345678 is no card", "password: internationalization"])))
            else:
                kind = rng.choice(sorted(pool))
                who = rng.choice(pool[kind])
                pieces.append((kind, who, spellings(rng, kind, who)))
        titled = {x for k, who, t in pieces if k == "name" and re.match(r"(?i)(mrs|ms|frau|madame|mr|herr|monsieur|dr|prof)\b", t) for x in (who[1].lower(), " ".join(who).lower() if len(t.split()) == 3 else "")}
        upper = {x for k, who, t in pieces if k == "name" and t.startswith("Prof ") for x in (who[1].lower(), " ".join(who).lower())}
        kept = []
        for k, who, t in pieces:
            if k == "name" and t in (who[1], " ".join(who)):  # without a form of address: only if the text has one, in these letters
                forms = {y for k2, w2, t2 in pieces if k2 == "name" and w2 and t2.split()[0].rstrip(".") in ("Mrs", "Ms", "Frau", "Madame", "Mr", "Herr", "Monsieur", "Dr") for y in (w2[1], " ".join(w2) if len(t2.split()) == 3 else w2[1])}
                if t not in forms:
                    continue
            kept.append((k, who, t))
        assert titled or not upper
        docs.append(kept)
    return docs


@pytest.mark.parametrize("most", [pii.MAX_EXCEPTIONS, -1])
def test_known_entities(spark, most):
    docs = make(random.Random(5))
    rows = [(k, (x := " ; ".join(t for _, _, t in d)), len(x), "x") for k, d in enumerate(docs)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, n_chars int, `m.e` string").repartition(3)
    got = {r["doc_id"]: r for r in pii.replace(frame, "key", length="n_chars", max_exceptions=most).collect()}
    assert len(got) == len(docs)
    to = defaultdict(set)
    seen = 0
    for k, d in enumerate(docs):
        out = got[k]["text"].split(" ; ")
        assert len(out) == max(1, len(d)) and got[k]["n_chars"] == len(got[k]["text"])
        for (kind, who, old), new in zip(d, out):
            if kind is None:
                assert new == old
                continue
            seen += 1
            if kind == "name":
                head = re.match(r"((?:Mrs|Ms\.|Frau|Madame|Mr\.|Herr|Monsieur|Dr\.|Prof) )?(.*)", old)
                tail = new.removeprefix(head[1] or "")
                assert new.startswith(head[1] or "") and len(tail.split()) == len(head[2].split())
                assert all(x.isupper() for x in tail.split()) == (old.startswith("Prof"))
                names = tail.lower().split()
                to["surname", who[1]].add(names[-1])
                if len(names) == 2:
                    to["given", who[0]].add(names[0])
            elif kind == "phone":
                assert shape(new) == shape(old) and re.match(r"\D*1\D", new + " ") is not None or not old.startswith(("+1", "1-"))
                to[kind, who].add(re.sub(r"\D", "", new)[-10:])
            elif kind == "card":
                n = re.sub(r"\D", "", new)
                assert shape(new) == shape(old) and n[0] == who[0] and luhn(n[:-1]) == n[-1]
                to[kind, who].add(n)
            elif kind == "email":
                local, domain = new.split("@")
                assert domain.rsplit(".", 1)[-1].lower() == who.rsplit(".", 1)[-1] and len(local) == max(6, len(who.split("@")[0]))
                to[kind, who].add(new.lower())
            elif kind == "secret":
                value = re.search(r'[=:] ?"?([^"]+)"?$', new)[1]
                kinds = lambda x: re.sub("[0-9]", "0", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", x)))
                assert new.startswith(old[: old.index(who)]) and len(value) == len(who)
                assert re.fullmatch("[0-9a-f]+", value) if re.fullmatch("[0-9a-f]+", who) else kinds(value) == kinds(who)
                to[kind, who].add(value)
            elif kind == "ip":
                private = lambda x: next((p for p in ("10.", "192.168.", "127.") if x.startswith(p)), "172" if re.match(r"172\.(1[6-9]|2\d|3[01])\.", x) else "")
                assert private(new) == private(who) and all(0 <= int(x) < 256 for x in new.split("."))
                to[kind, who].add(new)
            else:
                assert shape(new) == shape(old)
                to[kind, who].add(new)
    assert seen > 400
    assert all(len(v) == 1 for v in to.values()), {k: v for k, v in to.items() if len(v) > 1}  # coreference
    told = {who[0] for d in docs for kind, who, t in d if kind == "name" and len(t.split()) == 3 and t.split()[0].rstrip(".") not in ("Dr", "Prof")}
    assert len(told) >= 5
    by_kind = defaultdict(list)
    for (kind, who), (new,) in to.items():
        by_kind[kind].append(new)
        assert new != (who.lower() if isinstance(who, str) else who)
        if kind == "given" and who in told:
            assert new.endswith("a") == (GIVEN[who] == "f")
    assert all(len(set(v)) == len(v) for v in by_kind.values())  # distinctness


def test_cases(spark):
    """Nulls, empty and long texts, repeated rows, clashing names, an empty table."""
    long = "word " * 50_000 + "Frau Anna Keller " + "word " * 50_000 + "Anna Keller, Keller."
    rows = [(None, None), (None, ""), (1, long), (1, long), (2, "+33 1 23 45 67 89"), (3, "2001:0db8:85a3:0000:0000:8a2e:0370:7334 1:2:3")]
    docs = spark.createDataFrame([(k, t, "a", 1) for k, t in rows], "doc_id bigint, text string, type string, m int")
    got = pii.replace(docs, "key")
    assert got.columns == docs.columns and pii.replace(docs.where("false"), "key").count() == 0
    back = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert sorted(t or str(t) for k, t in back if k is None) == ["", "None"]
    a, b = (t for k, t in back if k == 1)
    assert a == b and "Anna" not in a and "Keller" not in a and len(a.split()) == len(long.split())
    names = re.search(r"Frau (\w+ (\w+)) ", a)
    assert a.endswith(f"{names[1]}, {names[2]}.")
    phone, six = dict(back)[2], dict(back)[3]
    assert re.fullmatch(r"\+33 \d \d\d \d\d \d\d \d\d", phone) and phone != rows[4][1]
    assert re.fullmatch(r"2001(:[0-9a-f]{4}){7} 1:2:3", six) and six != rows[5][1]
