"""Conversation repair, vector codes and license scans against plain versions, on awkward rows and empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest

from lumenary.llm import conversations, licenses, vector_codes
from lumenary.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import difference

# conversation repair

CONV = "conv_id long, turn long, role string, text string, head string, place int, block int, digest string, copy int"


def convs_of(spark, rows):
    return spark.createDataFrame([(*r, "h", 1, 2, "d", 3) for r in rows], CONV)


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


def ordered(turns):
    return sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))


def faults_of(turns):
    seen, out = set(), []
    for _, _, role, text in turns:
        spare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("b" if not spare else "d" if (role, text) in seen else "t" if spare[-1] not in ".!?" else ".")
        seen.add((role, text))
    return out


def paths(turns, faults):
    """(cost, audit, repaired) of every way to repair, with at most two insertions between turns."""
    out = []

    def go(i, run, cost, audit, said):
        if i == len(turns):
            out.append((cost, audit, said))
        else:
            role, text = turns[i][2:]
            go(i + 1, 0, cost + 4, audit + "D", said)
            if faults[i] in ".t":
                more = 3 * (faults[i] == "t")
                go(i + 1, 0, cost + more, audit + "K", [*said, (role, text)])
                for r in ("user", "assistant"):
                    go(i + 1, 0, cost + 3 + more, audit + "R", [*said, (r, text)])
        if run < 2:
            for r in ("user", "assistant"):
                go(i, run + 1, cost + 3, audit + "I", [*said, (r, "")])

    go(0, 0, 0, "", [])
    return [p for p in out if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in p[2]))]


def plain_repair(turns, faults):
    """(cost, audit, repaired) by a memoised recursion over suffixes; strings are compared whole."""
    step = {0: "su", 1: "u", 2: "a", 3: "u"}
    go_to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @cache
    def best(i, state, run):
        found = [(0, "", ())] if i == len(turns) and state in (0, 3) else []
        if i < len(turns):
            role, text = turns[i][2:]
            cost, audit, said = best(i + 1, state, 0)
            found.append((cost + 4, "D" + audit, said))
            if faults[i] in ".t":
                more = 3 * (faults[i] == "t")
                for edit, price, name in (("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")):
                    if name[:1] and name[:1] in step[state]:
                        cost, audit, said = best(i + 1, go_to[state, name[:1]], 0)
                        found.append((cost + price + more, edit + audit, ((name, text), *said)))
        if run < 3:
            for name in ("user", "assistant"):
                if name[0] in step[state]:
                    cost, audit, said = best(i, go_to[state, name[0]], run + 1)
                    found.append((cost + 3, "I" + audit, ((name, ""), *said)))
        return min(found, default=(10**9, "", ()), key=lambda x: x[:2])

    for i in range(len(turns), -1, -1):  # from the end, so that the recursion stays shallow
        for state, run in itertools.product(range(4), range(3, -1, -1)):
            best(i, state, run)
    return best(0, 0, 0)


def brute_audit(rows):
    """conv_id -> the contract's row for these turns after damage."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = ordered([t for t in after_damage(rows) if t[0] == conv])
        faults, numbers = faults_of(turns), [t[1] for t in turns if t[1] is not None]
        initials = [t[2][:1] for t in turns]
        cost, audit, said = plain_repair(tuple(turns), tuple(faults))
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest(),
        )
    return out


def got_audit(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def random_turns(rng, n):
    return [(rng.choice([1, 2, 2, 3]), rng.randrange(n) if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", "tool", "user", "assistant", None, ""]), rng.choice(["Hi.", "so", "Yes!", " ", "", None, "Why?", "well, no.\n", f"t{rng.random()}."])) for _ in range(n)]


def test_best_path_of_all():
    """The recursion of the tests itself, against every path."""
    rng = random.Random(5)
    for _ in range(150):
        turns = [(1, i, rng.choice(["user", "assistant", "system", "tool"]), "x") for i in range(rng.randrange(4))]
        faults = [rng.choice("..tbd") for _ in turns]
        want = min(p[:2] for p in paths(turns, faults))
        assert plain_repair(tuple(turns), tuple(faults))[:2] == want
        marks = "".join(t[2][0] if t[2][0] in "sua" else "-" for t in turns), "".join(faults)
        assert conversations.joined([conversations.matrix(*marks)] if turns else []) == want


def test_blocks_join_to_the_whole():
    """A conversation that is cut anywhere has the path of the whole one."""
    rng = random.Random(6)
    for _ in range(120):
        n = rng.randrange(1, 40)
        roles, faults = "".join(rng.choice("suaua-") for _ in range(n)), "".join(rng.choice("....ttbd") for _ in range(n))
        want = plain_repair(tuple((1, i, {"s": "system", "u": "user", "a": "assistant", "-": "tool"}[r], "x") for i, r in enumerate(roles)), tuple(faults))[:2]
        cuts = sorted({0, n, *(rng.randrange(n) for _ in range(rng.randrange(6)))})
        parts = [conversations.matrix(roles[a:b], faults[a:b]) for a, b in itertools.pairwise(cuts)]
        assert conversations.joined(parts) == want


def test_repair_of_awkward_rows(spark):
    rng = random.Random(7)
    rows = [*random_turns(rng, 150), (None, None, None, None), (None, 3, "user", "A."), (None, 3, "assistant", "B."), (9, None, None, None), (10, 1, "user", "x" * 200_000 + "."), (10, 2, "assistant", "fine.")]
    rows += [(11, 5, "user", "Same."), (11, 5, "user", "Same."), (11, 6, "assistant", "Same."), (11, 6, "assistant", "Same.")] + [(100 + i, i % 5, "user", "One.") for i in range(60)]
    assert got_audit(conversations.repair_damaged(convs_of(spark, rows).repartition(3))) == brute_audit(rows)
    dropped = [i for i in range(3000, 3100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0]
    gone = got_audit(conversations.repair_damaged(convs_of(spark, [(i, 0, "user", "x.") for i in dropped])))
    assert dropped and gone == {i: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for i in dropped}
    assert conversations.repair_damaged(convs_of(spark, [])).count() == 0 == conversations.repaired(convs_of(spark, [])).count()


def test_long_conversation_in_blocks(spark, monkeypatch):
    """One conversation with most rows, over many blocks and tasks."""
    monkeypatch.setattr(conversations, "BLOCK", 16)
    rng = random.Random(8)
    rows = [(7, i // 2, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["Yes.", "no", f"a {i}.", f"b {i}"])) for i in range(700)] + [(i, 0, "user", "Hi.") for i in range(20, 60)]
    assert got_audit(conversations.repair_damaged(convs_of(spark, rows).repartition(5))) == brute_audit(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Why?"), (1, 2, "tool", "Because."), (2, 0, "user", "One."), (2, 1, "user", "One."), (2, 2, "assistant", "Two."), (3, 0, "user", " ")]
    got = sorted(tuple(r) for r in conversations.repaired(convs_of(spark, rows)).collect())
    want = []
    for conv in (1, 2, 3):
        turns = ordered([r for r in rows if r[0] == conv])
        said = plain_repair(tuple(turns), tuple(faults_of(turns)))
        edits = [e for e in said[1] if e != "D"]
        want += [(conv, i, e, *t) for i, (e, t) in enumerate(zip(edits, said[2], strict=True))]
    assert got == want


def test_conversations_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got_audit(QUERIES["op11_conversation_repair"](spark, sf_dir)) == brute_audit(rows)


# vector codes

VECTORS = "vec_id long, embedding array<float>, label int, codes int, v string, error long, of int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "x", 2, 3) for i, v, lab in rows], VECTORS)


def plain_codes(rows):
    kept = [(i, [int(np.floor(float(np.float32(x)) * 256)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, digests = {}, []
    for d in sorted({len(v) for _, v, _ in kept}):
        own = [r for r in kept if len(r[1]) == d]
        cuts = [(p * d // 16, (p + 1) * d // 16) for p in range(16)]
        first = sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:64]
        books = [[list(r[1][a:b]) for r in first] for a, b in cuts]

        def nearest(v):
            return [min(((sum((x - y) ** 2 for x, y in zip(v[a:b], c, strict=True)), e) for e, c in enumerate(books[p]))) for p, (a, b) in enumerate(cuts)]

        for _ in range(2):
            sums = {}
            for _, v, _ in own:
                for p, (_, e) in enumerate(nearest(v)):
                    sums.setdefault((p, e), []).append(v[cuts[p][0] : cuts[p][1]])
            for (p, e), got in sums.items():
                books[p][e] = [sum(c) // len(got) for c in zip(*got, strict=True)]
        for i, v, lab in own:
            found = nearest(v)
            out.setdefault((i, tuple(v)), []).append(("".join(f"{e:02x}" for _, e in found), sum(x for x, _ in found), lab))
        digests.append(",".join(str(x) for own_books in books for c in own_books for x in c))
    totals = {}
    for found in out.values():
        for _, error, lab in found:
            totals[lab] = totals.get(lab, 0) + error
    digest = hashlib.sha256(",".join(x for x in digests if x).encode()).hexdigest()
    return sorted(((i, code, error, totals[lab], digest) for (i, _), found in out.items() for code, error, lab in found), key=str)


def test_exponion_is_exact():
    rng = np.random.default_rng(1)
    for n, width, spread in ((64, 4, 30), (64, 4, 3), (1, 3, 5), (7, 1, 4), (64, 0, 1), (64, 8, 1 << 22)):
        entries, x = rng.integers(-spread, spread + 1, (n, width)), rng.integers(-spread, spread + 1, (500, width))
        code, error = vector_codes.exponion(x, entries, rng.integers(0, n, 500))
        every = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        assert (code == every.argmin(1)).all() and (error == every.min(1)).all()


def test_vector_codes_of_awkward_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(32)], rng.choice([1, 2, None])) for i in range(150)]
    rows += [(3, rows[3][1], 1), (3, rows[3][1], 1), (5, rows[9][1], 2), (None, rows[8][1], None), (1000, None, 1), (1001, [0.1, None] * 16, 1), (1002, [float("nan")] * 32, 1), (1003, [float("-inf")] * 32, 1)]
    rows += [(2000 + i, [rng.random() for _ in range(20)], 7) for i in range(10)] + [(3000, [], 8), (3001, [0.5, -0.5, 1 / 256], 8), (3002, [0.5, -0.5, -1 / 512], 8)]
    got = vector_codes.compress(vectors_of(spark, rows).repartition(3)).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got), key=str) == plain_codes(rows)
    far = vector_codes.compress(vectors_of(spark, [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1), (3, [0.0] * 16, None)])).collect()
    assert len(far) == 3 and {r.error for r in far} == {0}
    assert vector_codes.compress(vectors_of(spark, [])).count() == 0 == vector_codes.compress(vectors_of(spark, [(1, None, 1)])).count()


def test_vector_codes_agree_with_sql(spark, sf_dir):
    assert difference(spark, QUERIES["op12_vector_codes"], ORACLE_SQL["op12_vector_codes"], sf_dir) is None


# license scans

MIT = dict(licenses.TEMPLATES[1:2])["MIT"]


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_pattern(markup, spell):
    """A template as a regular expression over words that are each followed by one space."""
    out, done = [], 0
    for mark in [*re.finditer(r"<<(optional|end|var (\d+)-(\d+))>>", markup), None]:
        for w in plain_words(markup[done : mark.start() if mark else None]):
            out.append(f"(?:{'|'.join([w, *licenses.SPELLINGS.get(w, [])]) if spell else w}) ")
        if mark:
            done = mark.end()
            out.append("(?:" if mark[1] == "optional" else ")?" if mark[1] == "end" else f"(?:\\S+ ){{{mark[2]},{mark[3]}}}")
    return re.compile("(?<!\\S)(?:" + "".join(out) + ")")


def plain_licenses(rows):
    patterns = [(label, True, plain_pattern(m, False)) for label, m in licenses.BASE.items()] + [(label, False, plain_pattern(m, True)) for label, m in licenses.TEMPLATES]
    out = []
    for i, text in rows:
        words = plain_words(text)
        line, places = "".join(w + " " for w in words), {}
        at = 0
        for n, w in enumerate(words):
            places[at] = n
            at += len(w) + 1
        found = [(label, base, places[p]) for label, base, pattern in patterns for p in places if pattern.match(line, p)]
        base = [f for f in found if f[1]]
        out.append((i, len(words), len(base), min((f[2] for f in base), default=None), max((f[2] for f in base), default=None), ",".join(sorted({f[0] for f in base})), ",".join(sorted({f[0] for f in found}))))
    return sorted(out, key=str)


def filled(markup, rng):
    """A text that the template accepts."""
    text = re.sub(r"<<var (\d+)-(\d+)>>", lambda m: " ".join(rng.choice(["Acme", "Inc", "the", "Ünïted", "2024"]) for _ in range(rng.randint(int(m[1]), int(m[2])))), markup)
    return re.sub(r"<<optional>>(.*?)<<end>>", lambda m: m[1] if rng.random() < 0.5 else "", text, flags=re.S)


def license_rows():
    rng = random.Random(11)
    rows = [(1, None), (2, ""), (3, "MIT License mit  LICENSE, mit-license"), (3, "MIT License"), (None, "Apache\nLicense"), (4, "the mit licence and MITLicense"), (5, "general public license general public license"), (6, "word " * 60_000 + "mit license"), (7, "\x7fmit\x7flicense\x00é")]
    for n, (_, markup) in enumerate(licenses.TEMPLATES):
        for k in range(4):
            text = filled(markup, rng)
            rows.append((100 * n + 100 + k, f"Some words. {text.upper() if k % 2 else text} And more."))
            words = plain_words(text)
            gone = rng.randrange(len(words))
            rows.append((100 * n + 110 + k, " ".join(words[:gone] + words[gone + 1 :])))  # one word is lost
            rows.append((100 * n + 120 + k, " ".join(words[:gone] + ["intruder"] + words[gone:])))
    return rows


@pytest.fixture(scope="module")
def licensed(spark):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in license_rows()], "doc_id long, text string, label string, n_words int, spans string")


def test_license_scan(spark, licensed):
    got = licenses.label_licenses(licensed.repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got), key=str) == plain_licenses(license_rows())
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)
    assert licenses.label_licenses(licensed.where("1 = 0")).count() == 0


def test_license_spans():
    automaton = licenses.compiled([("X", "alpha <<optional>> beta <<end>> gamma <<var 0-2>>"), ("Y", "alpha <<var 1-2>> gamma")], {"b": "alpha beta"})
    text = [w.encode() for w in "alpha beta gamma one two three alpha gamma alpha alpha gamma".split()]
    found = [(s, e, automaton.labels[t][0]) for s, e, t in automaton.spans(text)]
    assert found == [(0, 2, "b"), (0, 5, "X"), (0, 3, "Y"), (6, 10, "X"), (8, 11, "Y"), (9, 11, "X")]
    assert licenses.covered(automaton.spans(text)) == 10
    with pytest.raises(ValueError, match="replaceable"):
        licenses.compiled([("Z", "<<var 1-2>> alpha")], {})


def test_licenses_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_license_scan"](spark, sf_dir).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got), key=str) == plain_licenses(rows)


# main text: wrapped forms, comments, and boxes within articles

PROSE = "<p>This is a long paragraph of prose about the pump, which runs, and about valves that open and close when the pressure falls.</p>"


@pytest.mark.parametrize("page, kept", [
    (f"<body><form id=aspnetForm><input type=hidden><article>{PROSE * 4}</article></form></body>", 4), (f"<body><main><form><input>{PROSE * 4}</form></main></body>", 4),
    (f"<body><article>{PROSE}<!-- x --!>{PROSE}</article></body>", 2), (f"<body><article>{PROSE}<!-->{PROSE}<!--->{PROSE}<!-- a -- b --></article></body>", 3),
    *[(f"<body><main><article>{PROSE}<div class='{c}'>{PROSE}</div>{PROSE}</article></main></body>", 2) for c in ("ad", "comments", "cookie-notice", "newsletter", "sidebar", "promo", "related")],
    (f"<body><main><article>{PROSE}<aside>{PROSE}</aside>{PROSE}</article></main></body>", 2), (f"<body><div class=social><main><article>{PROSE * 3}</article></main></div></body>", 3),
    (f"<body><article>{PROSE * 2}</article><form><p>Write to us and we will answer as soon as we can, which may take a day or two of work.</p><input><input><textarea></textarea><button>Go</button></form></body>", 2),
])
def test_boxes_and_forms(page, kept):
    from lumenary.llm import html_extract

    text = html_extract.main_text(page)
    assert text.split("\n") == [re.sub("</?p>", "", PROSE)] * kept
