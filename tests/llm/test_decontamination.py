import random
import re

from loomline.llm import decontamination as D

from .helpers import docs, empty, prose

QUESTION = "A train leaves Boston at 60 mph and travels for 3 hours before it meets Maria who walks 4 km along the river to the old station"
OTHER = "The baker sells 12 loaves to Peter each day and keeps 7 of them for the poor people of the village near the sea"


def bench(spark, rows=None):
    rows = [(1, QUESTION), (2, OTHER), (3, "too short"), (4, None), (5, "")] if rows is None else rows
    return spark.createDataFrame(rows, "item_id long, text string")


CASES = {
    "verbatim": (f"Some text. {QUESTION}. More text.", {1}),
    "upper case": (QUESTION.upper(), {1}),
    "other numbers and names": (QUESTION.replace("Boston", "Denver").replace("60", "85").replace("Maria", "Anna").replace(" 4 ", " 9 "), {1}),
    "inconsistent slots": (" ".join(QUESTION.split()[:9]).replace("Boston", "Denver").replace("60", "85") + " and so on to the end of it all", set()),
    "half": (" ".join(QUESTION.split()[:14]) + " is something else altogether", {1}),
    "a few words": ("He said that it meets Maria who walks home.", set()),
    "both": (f"{OTHER} {QUESTION}", {1, 2}),
    "clean": (prose(random.Random(3), 300), set()),
}


def test_cases(spark):
    frame = docs(spark, [t for t, _ in CASES.values()] + [None, "", CASES["verbatim"][0]])
    got = {}
    for r in D.contaminated(frame, bench(spark)).collect():
        got.setdefault(r.doc_id, set()).add(r.item_id)
    for i, (name, (_, want)) in enumerate(CASES.items()):
        assert got.get(i, set()) == want, name
    assert got[len(CASES) + 2] == {1}
    kept = {r.doc_id for r in D.decontaminate(frame, bench(spark)).collect()}
    assert kept == {i for i, (_, want) in enumerate(CASES.values()) if not want} | {len(CASES), len(CASES) + 1}


TOM = "Tom buys 12 red apples at the market. Tom gives 3 apples to his sister. Tom eats 2 more. How many apples does Tom have left?"
REWRITES = {
    "a name that begins sentences": TOM.replace("Tom", "Kim").replace("12", "40").replace(" 3 ", " 9 ").replace(" 2 ", " 5 "),
    "names and numbers of two words": TOM.replace("Tom", "Mary Ann").replace("12", "twenty-five").replace(" 3 ", " nine "),
    "another name each time": TOM.replace("Tom buys", "Kim buys").replace("Tom gives", "Ann gives").replace("Tom eats", "Bob eats").replace("12", "40").replace(" 3 ", " 9 ").replace(" 2 ", " 5 "),
    "begins inside a sentence": "They say that " + TOM.replace("Tom", "Kim"),
    "other words around the numbers": "Tom sold 12 blue cars in the city. Tom sent 3 letters to his mother. Tom drank 2 more. How many coins did Tom find?",
}


def test_questions_with_other_names_and_numbers(spark):
    frame = docs(spark, list(REWRITES.values()))
    got = {r.doc_id: (r.covered_tokens, r.n_tokens) for r in D.contaminated(frame, bench(spark, [(1, TOM)])).collect()}
    assert set(got) == {0, 1, 3} and all(c == n for c, n in got.values())
    boston = "The train from Boston to New York takes 4 hours and stops at every small station along the old coast"
    other = boston.replace("Boston", "Los Angeles").replace("New York", "Reno").replace("4", "thirty six")
    assert [r.covered_tokens == r.n_tokens for r in D.contaminated(docs(spark, [other]), bench(spark, [(1, boston)])).collect()] == [True]


def test_slots_that_change_within_a_document_do_not_fit(spark):
    item = "In the town of Rome 5 men met Anna and in the town of Rome 5 women met Anna again"
    good, bad = item.replace("Rome", "Oslo"), item.replace("Rome", "Oslo", 1).replace("Rome", "Bern", 1)
    rows = D.contaminated(docs(spark, [good, bad]), bench(spark, [(1, item)])).collect()
    assert [r.doc_id for r in rows] == [0]


def test_the_join_without_a_screen_agrees(spark, monkeypatch):
    frame = docs(spark, [t for t, _ in CASES.values()])
    pairs = lambda: sorted((r.doc_id, r.item_id, r.covered_tokens) for r in D.contaminated(frame, bench(spark)).collect())
    first = pairs()
    monkeypatch.setattr(D, "SCREEN_WINDOWS", 0)
    assert pairs() == first


def test_siblings_and_half_verbatim_items_with_and_without_a_screen(spark, monkeypatch):
    sibling = QUESTION.replace("Boston", "Denver").replace("60", "85").replace("Maria", "Anna")
    tom = "At noon the farmer asked Tom to count all the sheep on the green hill and later in the evening he thanked Tom for the work and gave him a loaf of bread"
    half = "Tom".join(tom.split("Tom")[:2]) + "Jim" + tom.split("Tom")[2]
    frame, items = docs(spark, [QUESTION, half]), bench(spark, [(1, QUESTION), (2, sibling), (3, tom)])
    pairs = lambda: sorted((r.doc_id, r.item_id, r.covered_tokens, r.n_tokens) for r in D.contaminated(frame, items).collect())
    first = pairs()
    n = len(tom.split())
    assert [p[:2] for p in first] == [(0, 1), (0, 2), (1, 3)] and n / 2 <= first[2][2] < n
    monkeypatch.setattr(D, "SCREEN_WINDOWS", 0)
    assert pairs() == first


def test_items_shorter_than_a_window(spark):
    items = bench(spark, [(1, "What is the capital of France"), (2, "name the seven seas"), (3, "how so"), (4, "Where did the poor old Tom go")])
    frame = docs(spark, ["He asked: what is the capital of France?", "they name the seven seas", "how so", "Where did the poor old Jim go", "what is the capital of Spain", "the seven seas"])
    got = sorted((r.doc_id, r.item_id, r.covered_tokens) for r in D.contaminated(frame, items).collect())
    assert got == [(0, 1, 6), (1, 2, 4), (3, 4, 7), (4, 1, 6)]


def plain_tokens(text):
    """Lower-case tokens, and units as (text, kind, first token, last token + 1), read word by word."""
    tokens, units, before, was = [], [], 0, 0
    for m in re.finditer(r"(?:[0-9A-Za-z\x80-\U0010ffff]|(?<=[0-9])[.,](?=[0-9]))+", text or ""):
        token, low = m[0], m[0].lower()
        gap = text[before : m.start()]
        inside = bool(tokens) and not set(gap) & set('.!?:;\n"')
        if token[0] in "0123456789" or low in D.NUMBER_WORDS:
            kind = 1
        elif was == 1 and low in D.UNITS:
            kind = 2
        else:
            kind = 3 * (("A" <= token[0] <= "Z" or "À" <= token[0] <= "Þ") and (inside or low not in D.COMMON))
        if kind in (1, 3) and kind == was and gap in (" ", "-"):
            units[-1] = (units[-1][0] + " " + low, kind, units[-1][2], len(tokens) + 1)
        else:
            units.append((low, kind, len(tokens), len(tokens) + 1))
        tokens.append(low)
        before, was = m.end(), kind
    return tokens, units


def brute(texts, items):
    found = set()
    for i, text in enumerate(texts):
        doc, doc_units = plain_tokens(text)
        for item_id, item_text in items:
            item, units = plain_tokens(item_text)
            n, tokens = len(item), set()
            width = min(n, D.WINDOW)
            for p in range(n - width + 1) if n >= D.SHORTEST else ():
                if any(doc[q : q + width] == item[p : p + width] for q in range(len(doc) - width + 1)):
                    tokens |= set(range(p, p + width))
            m, width = len(units), min(len(units), D.WINDOW)
            for line in range(-m, len(doc_units)) if m >= D.SHORTEST else ():
                fit, pairs, words = set(), set(), set()
                for p in range(m - width + 1):
                    if not 0 <= p + line <= len(doc_units) - width:
                        continue
                    a, b = units[p : p + width], doc_units[p + line : p + line + width]
                    held = [k for k in range(width) if a[k][1]]
                    if held and width - len(held) >= D.WINDOW_LITERAL and [x[1] or x[0] for x in a] == [x[1] or x[0] for x in b]:
                        fit |= set(range(a[0][2], a[-1][3]))
                        pairs |= {(a[k][:2], b[k][:2]) for k in held}
                        words |= {p + k for k in range(width) if k not in held}
                if len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs}) and len(words) >= D.LEAST_LITERAL:
                    tokens |= fit
            longest = run = 0
            for k in range(n):
                run = run + 1 if k in tokens else 0
                longest = max(longest, run)
            if tokens and (2 * len(tokens) >= n or longest >= D.LONG_RUN):
                found.add((i, item_id, len(tokens), n))
    return found


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    names, words = ["Tom", "Ann", "Rome", "Oslo", "Émile"], "the man of a house near that old road went in with two red dogs and more".split()

    def piece(n):
        return " ".join(rng.choice(names) if rng.random() < 0.3 else f"{rng.randint(1, 99)} {rng.choice(['km', 'kg', 'days', 'men'])}" if rng.random() < 0.2 else rng.choice(words) for _ in range(n))

    items = [(k, piece(rng.randint(2, 24)) + rng.choice(["", "?", "."])) for k in range(12)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 3)):
            tokens = rng.choice(items)[1].split()
            swap = {name: rng.choice(names) for name in names} | {str(k): str(rng.randint(1, 99)) for k in range(100)}
            if rng.random() < 0.7:
                tokens = [swap.get(t, t) if rng.random() < 0.9 else t for t in tokens]
            parts += [piece(rng.randint(0, 10)), " ".join(tokens[rng.randint(0, 4) :])]
        texts.append(rng.choice([" ", ". "]).join(parts))
    want = brute(texts, items)
    got = {(r.doc_id, r.item_id, r.covered_tokens, r.n_tokens) for r in D.contaminated(docs(spark, texts), bench(spark, items)).collect()}
    assert got == want and len(want) > 20
    monkeypatch.setattr(D, "SCREEN_WINDOWS", 0)
    assert {(r.doc_id, r.item_id, r.covered_tokens, r.n_tokens) for r in D.contaminated(docs(spark, texts), bench(spark, items)).collect()} == want


def test_empty_tables(spark):
    assert D.contaminated(empty(spark), bench(spark)).collect() == []
    assert D.contaminated(docs(spark), bench(spark, [])).collect() == []
    assert D.decontaminate(docs(spark), bench(spark, [])).count() == docs(spark).count()


def test_clean_texts_are_not_moved(spark):
    """Only texts with a contaminated one's key are joined; a row of the same text is told by its doc_id."""
    item = " ".join(f"item{i} word{i}" for i in range(12))
    frame = docs(spark, [prose(random.Random(1), 60), "start " + item + " end", None, prose(random.Random(2), 60)])
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = D.decontaminate(frame, benchmark)
    assert kept.columns == frame.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in frame.collect() if not (r.text or "").startswith("start"))
    assert "Union" in kept._jdf.queryExecution().optimizedPlan().toString()
