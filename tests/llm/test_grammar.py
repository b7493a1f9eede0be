import random
from collections import Counter

from tessera.llm import grammar as G
from tessera.llm import toxicity


def brute(symbols):
    """The grammar's rules, each looked up in the whole sequence."""
    found = Counter()
    words, clause, sentence, quoted, since = [], 0, 0, False, None
    rows = []  # (symbol, clause, number of the word, quoted, reported)
    said = None  # (sentence, word) of the reporting verb whose speech goes on
    number = 0
    for a in symbols:
        if a == "stop":
            sentence, clause, said = sentence + 1, clause + 1, None
        elif a == "comma":
            clause += 1
            said = (said[0], -9) if said and said[1] >= 0 and number - said[1] < G.SAID else None
        elif a == "colon":
            clause += 1
            said = (said[0], -9) if said else None
        elif a == "quote":
            quoted = not quoted
            said = (said[0], -9) if said else None
        else:
            rows.append((a, clause, number, quoted, said is not None))
            number += 1
            if a == "report":
                said = (sentence, number)
    del words, since
    near = lambda i, kind, back, ahead: any(0 <= j < len(rows) and rows[j][0] == kind and rows[j][1] == rows[i][1] for j in range(i - back, i + ahead + 1) if j != i)
    for i, (a, c, _, q, r) in enumerate(rows):
        if a == "insult":
            negated = near(i, "negation", G.NEGATED, 0)
            found["reported" if q or r else "negated" if negated else "directed" if near(i, "target", G.BEFORE, G.AFTER) else "plain"] += 1
        if a == "target":
            # the last harm verb before it with an intent, unless a target stands between or it is negated
            for j in range(i - 1, max(-1, i - G.AIMED - 1), -1):
                if rows[j][1] != c or rows[j][0] == "target":
                    break
                if rows[j][0] == "harm" and near(j, "intent", G.INTENDED, 0):
                    said_so = rows[j][3] or rows[j][4]
                    if said_so or not near(j, "negation", G.NEGATED, 0):
                        found["reported" if said_so else "threat"] += 1
                        break
    return +found


def test_composition_against_the_rules():
    grammar, r = G.Grammar(), random.Random(31)
    for _ in range(6000):
        s = r.choices(G.SYMBOLS, weights=[8, 3, 2, 2, 3, 2, 1, 1, 1, 1, 1], k=r.randint(0, 16))
        assert +grammar.classes(s) == brute(s), s
    assert 100 < len(grammar.rows) < 100_000


def test_composition_is_the_cascade():
    machine = G.compose()
    parts, inputs = [], list(G.SYMBOLS)
    for start, step in ((0, G.negation), ((0, 0, False), G.reported), ((0, 0, ""), G.threat), (0, G.insult), ((0, ()), G.target)):
        parts.append(G.Transducer.of(start, inputs, step))
        inputs = parts[-1].outputs
    r = random.Random(2)
    for _ in range(300):
        state, states = machine.start, [p.start for p in parts]
        for a in r.choices(G.SYMBOLS, k=12):
            state, out = machine.arcs[state, a]
            for i, p in enumerate(parts):
                states[i], a = p.arcs[states[i], a]
            assert out == a


def test_clauses():
    lexicon = toxicity.Lexicon()
    one = lambda t: dict(+toxicity.matched(t, lexicon))
    assert one("He said: you are an idiot") == one("He said, you are an idiot") == {"reported": 1}
    assert one("“You are an idiot. Go away, moron.” That was it, you clown!") == {"reported": 2, "directed": 1}
    assert one("you aren’t an idiot") == {"negated": 1}
    assert one("i’ll kill you") == {"threat": 1}
    assert one("i will kill time") == {}
    assert one("he said i will kill you") == {"reported": 1}
    assert one("I will not kill you") == {}
    assert one("He said hello. You are an idiot") == {"directed": 1}
    assert one("nice\nyou are an idiot\nnice") == {"directed": 1}


def test_long_texts_are_read_in_linear_time():
    import time

    lexicon = toxicity.Lexicon()
    began = time.time()
    assert toxicity.matched("you idiot. " * 100_000, lexicon)["directed"] == 100_000
    assert toxicity.matched("idiot " * 100_000, lexicon)["plain"] == 100_000
    assert time.time() - began < 20
