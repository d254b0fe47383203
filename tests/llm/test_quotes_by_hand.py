"""Quotation links against brute force: all pairs of units of all messages of a conversation."""

import random
import re

from tallyforge.llm import quotes

MARKS, INTRO = re.compile(r"(?:\s{0,3}>)+"), re.compile(quotes.INTRO[4:], re.I)


def lines_of(text):
    out = []
    for x in re.split(r"\r?\n", text or ""):
        m = MARKS.match(x)
        out.append((m[0].count(">") if m else 0, x[m.end() if m else 0 :].strip(" ")))
    keep = []
    for i, (level, body) in enumerate(out):
        rest = [(n, b) for n, b in out[i + 1 :] if n or b]
        introduces = level == 0 and INTRO.match(body) and rest and rest[0][0] > 0
        keep.append((-1, "") if introduces else (level, body))  # what stands before and after it are two passages
    return keep, out


def passages_of(lines):
    out = []
    for i, (level, body) in enumerate(lines):
        if body and i and lines[i - 1][0] == level and lines[i - 1][1]:
            out[-1][1].append(body)
        elif body:
            out.append((level, [body]))
    return out


def units_of(lines):
    """(level, passage, kind, text) of each unit."""
    for at, (level, body) in enumerate(passages_of(lines)):
        whole = " ".join(body)
        for kind, text in [("passage", whole), *(("sentence", s) for s in re.split(r"(?<=[.!?])\s+", whole)), *(("line", x) for x in body)]:
            norm = " ".join(re.findall(r"[^\W_]+", text.lower()))
            if norm:
                yield level, at, kind, norm


def best(found):
    """Of each level the source that most characters come from, the latest of equal ones."""
    by = {}
    for level, at, source, kind, norm in set(found):
        by.setdefault((level, source), {}).setdefault(at, {}).setdefault(kind, set()).add(norm)
    out = {}
    for (level, source), passages in by.items():
        chars = sum(max(sum(map(len, norms)) for norms in kinds.values()) for kinds in passages.values())
        out[level] = max(out.get(level, (0, -1)), (chars, source))
    return {level: (source, chars) for level, (chars, source) in out.items()}


def by_hand(messages):
    out = {}
    kept = {t: lines_of(text)[0] for t, text in messages.items()}
    own = {t: {n for level, _, _, n in units_of(x) if level == 0} for t, x in kept.items()}

    def latest(norm, before):
        return max((t for t in own if t < before and norm in own[t]), default=None)

    for t, lines in kept.items():
        asked = [(level, at, latest(n, t), kind, n) for level, at, kind, n in units_of(lines) if level > 0]
        links = best(x for x in asked if x[2] is not None)
        if links:
            lowest, reply = min(links), links[min(links)][0]
            deeper = best(x for x in ((level, at, latest(n, reply), kind, n) for level, at, kind, n in units_of(lines) if level > lowest) if x[2] is not None)
            links |= {k: v for k, v in deeper.items() if k in links}
        else:
            reply = None
        body = "\n".join(b for level, b in lines if level == 0).strip(" ")
        out[t] = (reply, sorted((level, *x) for level, x in links.items()), body)
    return out


def test_links_of_generated_conversations(spark):
    rng = random.Random(2)
    words = "meet plan board please pay today report send again note river stone".split()
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(2, 5))).capitalize() + rng.choice(".!?")
    rows = []
    for conv in range(25):
        said = {}
        for turn in range(12):
            parts = []
            for _ in range(rng.randint(1, 4)):
                if said and rng.random() < 0.6:
                    quoted = rng.choice(list(said.values())).split("\n")
                    k = rng.randint(0, len(quoted) - 1)
                    if rng.random() < 0.7:
                        parts.append(rng.choice(["On Monday Ann wrote:", "Le lundi Bea a écrit :", "On Tuesday I wrote to the board as follows:"]))
                    parts += [""] * (rng.random() < 0.2)
                    parts += [("> " if rng.random() < 0.9 else ">") + x.upper() if rng.random() < 0.2 else "> " + x for x in quoted[k : k + 4]]
                else:
                    parts += [" ".join(sentence() for _ in range(rng.randint(1, 3))), rng.choice(["", "On Friday I wrote to the board as follows:"]), sentence()]
            said[turn] = "\n".join(parts)
        rows += [(conv, t, "r", x) for t, x in said.items()]
    got = {(r.conv_id, r.turn): r for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for conv in range(25):
        want = by_hand({t: x for c, t, _, x in rows if c == conv})
        for t, (reply, links, body) in want.items():
            r = got[conv, t]
            assert (r.reply_to, [tuple(x) for x in r.links], r.body) == (reply, links, body), (conv, t)


def test_introductions_stay_unless_a_quotation_follows(spark):
    texts = ["Hello there all.\nOn Monday I wrote to the board as follows:\nplease pay.", "Hi.\nOn Monday a wrote:\n\n\n> Hello there all.\nYes.", "On Monday a wrote:", "On Monday a wrote:\nOn Tuesday b wrote:\n> x y\nEnd", "> a b\nOn Monday a wrote:\n>\n> Hi.\nNo"]
    got = {r.turn: r.body for r in quotes.link(spark.createDataFrame([(1, i, "r", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: texts[0], 1: "Hi.\n\n\nYes.", 2: texts[2], 3: "On Monday a wrote:\nEnd", 4: "No"}


def test_a_long_message_and_clashing_names(spark):
    long = "\n".join(f"> quoted line {i}" if i % 3 else f"Own line number {i}." for i in range(150_000))
    rows = [(1, 0, "a", "quoted line 1\nquoted line 2\n" + long[:5_000_000]), (1, 1, "b", long)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as lines", "2 as passages", "'x' as hash", "3 as level", "4 as source")
    got = {r.turn: r for r in quotes.link(df).collect()}
    assert got[1].reply_to == 0 and got[1].n_quoted == 100_000 and got[1].depth_quoted == 1
