"""Line dedup, fill-in-middle and conversation repair against brute force on small messy tables."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from skyloom.llm import fill_middle, line_dedup, turn_repair

WS = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, doc string, mark string, dropped string, key string, pos string, n string, line string, h1 string, _m string, form string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *["clash"] * 10) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    common = ["Shared line number one, long enough", "  shared LINE number one, long enough\t", "a license line that is everywhere", "Été très long, voilà une ligne", "short", ""]
    words = ["alpha", "beta", "naïve", "😀", "gamma  delta", "\x0bx", "<P", "S>"]
    out = []
    for i in range(60):
        lines = [rng.choice(common) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 12))]
        out.append((i * 7 - 20, "\n".join(lines)))
    out += [out[3], out[3], (out[5][0], "a license line that is everywhere\nown text"), (None, "a license line that is everywhere"), (None, common[0] + "\n" + common[0]), (None, None)]
    out += [(900, None), (901, ""), (902, "\n\n"), (903, "   \t"), (904, "has <M> in it, long enough to count"), (905, "x" * 30_000), (906, " ".join(["w"] * 30_000)), (907, "no end of line\n"), (908, "twice in one doc, twenty points\n" * 4)]
    return out + [(909, "within two documents only, at least\n" * 3), (910, "within two documents only, at least")]


def plain_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))


@pytest.mark.parametrize("hot", [1000, 10_000])
def test_repeated_lines(spark, rows, hot, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", hot)  # the second: every hash is dealt over several ranges
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(plain_key(line)) >= 20:
                held[plain_key(line)].add(float("-inf") if i is None else i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        own = float("-inf") if i is None else i
        stay = [x for x in lines if not (len(held.get(plain_key(x), ())) >= 3 and max(held[plain_key(x)]) != own)]
        want.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    found = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.drop_repeated(frame(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert any(n for *_, n, _ in want)


def test_repeated_lines_of_nothing(spark):
    assert line_dedup.drop_repeated(frame(spark, [])).count() == 0


def plain_middle(i, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(tokens)
    h = sha(f"42:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return i, n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return i, n, out[0], len(p), len(m), out[1], text


def test_fill_in_middle(spark, rows):
    more = [*rows, *[(1000 + i, t) for i in range(12) for _, t in rows[:9]]]
    found = [tuple(r) for r in fill_middle.fill_in_middle(frame(spark, more)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()]
    want = [plain_middle(i, t) for i, t in more]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(frame(spark, [])).count() == 0


def test_chunks_and_their_sums():
    rng = random.Random(3)
    passage = "".join(rng.choice("ab c\t\n　é😀") for _ in range(20_000))
    summaries = fill_middle.Summaries()
    for text in (passage, "head " + passage, passage[7:] + " tail", "x" * 40_000, " " * 40_000, "a", " ", ""):
        counted = fill_middle.Counted(text, summaries)
        tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
        assert counted.tokens == len(tokens)
        for k in {0, 1, 2, len(tokens) // 3, len(tokens) - 1, len(tokens)} & set(range(len(tokens) + 1)):
            assert counted.end_of(k) == len("".join(tokens[:k]))
    assert summaries.hits > 20  # the shared passage's chunks were looked up again
    small = fill_middle.Summaries(limit=1000)
    fill_middle.Counted(passage, small)
    assert small.size <= 1000


def plain_repair(rows):
    """Dijkstra over (row, state) with (cost, audit) as the length."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1], sha(v[2])))
    seen, marks, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, r, x in rows:
        body = x.strip(WS)
        kind = "blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((r, x))
        marks.append(kind)
        if kind:
            counts[kind] += 1
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, said, out = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", said):
            break
        state = (at, said[-1:], said[:1] == "s" and len(said) == 1, said == "")
        if state in done:
            continue
        done.add(state)
        if said[-1:] in ("", "s", "u", "a") and len(said) < len(rows) * 2 + 4:
            role = "assistant" if said[-1:] == "u" else "user"
            heapq.heappush(heap, (cost + 2, audit + "I", at, said + role[0], (*out, f"{role}:")))
            if at < len(rows):
                _, r, x = rows[at]
                heapq.heappush(heap, (cost + 3, audit + "D", at + 1, said, out))
                if marks[at] not in ("blank", "duplicate"):
                    t = marks[at] == "truncated"
                    heapq.heappush(heap, (cost + 2 + t, audit + "R", at + 1, said + role[0], (*out, f"{role}:{x}")))
                    if r[:1] == role[0] or (r[:1] == "s" and not said):
                        heapq.heappush(heap, (cost + t, audit + "K", at + 1, said + r[0], (*out, f"{r}:{x}")))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha("\n".join(out))


TURNS = "conv_id long, turn long, role string, text string, conv string, digest string, fault string, place string"


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(11)
    out = []
    for c in [*range(25), None]:
        for k in range(rng.randint(1, 14)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "s", "u"])
            text = rng.choice(["Hello.", "What now?", "no end", "", "  \n", None, "Yes!  ", f"line {k}.", f"cut {k}", "."])
            out.append((c, rng.choice([k, k, k, k + 3, None, -k]), role, text))
    out += [(50, 1, "user", "Hi.")] * 6 + [(51, None, None, None)] * 2 + [(52, 3, "user", "word. " * 5000), (52, 9, "assistant", "Fine.")]
    return out + [(53, k, "user" if k % 2 == 0 else "assistant", f"t{k}" + "." * (k % 3)) for k in range(90)]


@pytest.mark.parametrize("piece", [turn_repair.PIECE, 1, 3])
def test_repair(spark, turns, piece):
    df = spark.createDataFrame([(*t, *["clash"] * 4) for t in turns], TURNS).repartition(3)
    found, repaired = turn_repair.repair(df, piece=piece)
    got = {r.conv: r.sha256 for r in turn_repair.digests(repaired).collect()}
    by = defaultdict(list)
    for c, *rest in turns:
        by[c].append(rest)
    want = {c: plain_repair(rows) for c, rows in by.items()}
    have = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, got.get(r.conv_id, sha(""))) for r in found.collect()}
    assert have == want


def test_repair_of_nothing(spark):
    found, repaired = turn_repair.repair(spark.createDataFrame([], TURNS))
    assert found.count() == 0 and repaired.count() == 0 and turn_repair.digests(repaired).count() == 0


def test_damage(spark, turns):
    found = turn_repair.damage(spark.createDataFrame([(*t, *["clash"] * 4) for t in turns], TURNS)).collect()
    want = []
    for c, t, r, x in turns:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r if r is not None else " ", x if x is not None else " "
        if k:
            want += [(c, t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)] * (2 if k == 3 else 1)
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_suffixes_are_made_once():
    automaton = turn_repair.Automaton()
    words = sorted(w[::-1] for w in ("sua", "ua", "uaua", "suaua", "xua", "Ua"))
    for w in words:
        automaton.add(w, "")
        assert len(automaton.nodes) == len(w) + 1
    assert len(automaton.made) < sum(map(len, words))  # equal costs are one node whatever the suffix
