"""Secret scan, source mixing and tool calls against plain Python."""

import hashlib
import heapq
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tarnhold.llm import mixing, secrets, toolcalls

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def shown(spans):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def check_secrets(docs):
    want = []
    for r in docs.collect():
        b = base_spans(r.text)
        want.append((str(r.doc_id), *[sum(k == i for _, k, _ in b) for i in range(3)], hashlib.sha256(shown(b).encode()).hexdigest()))
    got = secrets.digest(docs).collect()
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(want)
    return got


def test_secrets_whole_table(small):
    texts = {r.doc_id: r.text for r in small.collect()}
    for r in check_secrets(small):
        spans = r.spans.split(",") if r.spans else []
        assert {f"{s}" for s in shown(base_spans(texts[r.doc_id])).split(",") if s} <= set(spans)


def test_secrets_edges(edges, empty):
    check_secrets(edges)
    assert secrets.digest(empty).count() == 0 and secrets.redacted(empty).count() == 0


def test_secrets_random_and_clean(spark):
    rng = random.Random(5)
    key = "".join(rng.choice(secrets.UPPER + secrets.LOWER + secrets.DIGITS) for _ in range(48))
    docs = spark.createDataFrame([(1, f"look {key} here"), (2, "plain prose about nothing at all"), (3, "aaaaaaaaaa1aaaaaaaaaaaaaaaaaaa")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in secrets.digest(docs).collect()}
    assert got[1].spans == "random:5:53" and got[2].spans == "" and got[3].n_random == 0
    clean = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert clean[1] == "look <secret> here" and clean[2] == "plain prose about nothing at all"


def ordinary_runs(rng, count):
    """Words and numbers as names are made of them, in one case, in camel case, and numbers with a few letters."""
    words = "report value station under people number garden winter letter market signal amber".split()
    number = lambda: str(rng.choice([rng.randint(1, 9), rng.randint(10, 99), rng.randint(1900, 2030), rng.randint(10**5, 10**8)]))
    out = []
    for i in range(count):
        parts = [rng.choice(words) for _ in range(5)]
        parts[rng.randint(1, 3)] = number()
        coded = [rng.choice(["BAD", "FACE", "DEAD", "ADD", "FEED"]), number(), number(), "20240115", number()]
        out.append(["".join(parts) + "words", "".join(parts).upper() + "WORDS", "".join(p.capitalize() for p in parts) + "Words", ("".join(coded) * 2)[:40]][i % 4])
    return out


def test_secrets_of_every_encoding(spark):
    """Keys of usual lengths, one row in ten: most are found in every encoding, and no name is."""
    rng, rows = random.Random(11), []
    keys = {"hex": (32, 40, 64), "base32": (32, 40, 64), "base36": (25, 32, 40), "base36_upper": (25, 32, 40), "base62": (22, 32, 43), "base64": (24, 32, 43), "base64url": (24, 32, 43)}
    for encoding, lengths in keys.items():
        alphabet = secrets.ENCODINGS[encoding][1]
        for n in lengths:
            for _ in range(40):
                rows.append((f"{encoding} {n}", "".join(rng.choice(alphabet) for _ in range(n))))
    rows += [("name", x) for x in ordinary_runs(rng, 9 * len(rows))]
    # lower-case hex of 16 or more is a base span already, and a run needs a letter and a digit
    rows = [(i, kind, x) for i, (kind, x) in enumerate(rows) if re.search("[0-9]", x) and re.search("[A-Za-z]", x) and not base_spans(x)]
    docs = spark.createDataFrame(rows, "doc_id bigint, kind string, text string")
    got = {r.doc_id: r.n_random for r in secrets.digest(docs).collect()}
    share = lambda kind: (lambda found: sum(found) / len(found))([got[i] for i, k, _ in rows if k == kind])
    assert share("name") == 0
    for encoding, lengths in keys.items():
        for n in lengths:
            assert share(f"{encoding} {n}") >= 0.5, (encoding, n, share(f"{encoding} {n}"))


def plain_battery(body):
    """The battery once more, in plain Python over one value: encoding, bits against ordinary text, random or not."""
    for name, (pattern, alphabet) in secrets.ENCODINGS.items():
        if re.fullmatch(pattern[2:-2], body):
            break
    n, k = len(body), len(alphabet)
    chi = sum((body.count(x) - n / k) ** 2 / (n / k) for x in alphabet)
    v = [alphabet.index(x) - (k - 1) / 2 for x in body]
    turns = sum((a >= 0) != (b >= 0) for a, b in zip(v, v[1:]))
    own = sum(a * a for a in v)
    serial = sum(a * b for a, b in zip(v, v[1:])) / own if own else 1.0
    z = [max(0.0, (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)), (turns - (n - 1) / 2) / math.sqrt((n - 1) / 4), (serial + 1 / n) * math.sqrt(n)]
    kind = lambda x: "d" if x.isdigit() else "u" if x.isupper() else "l" if x.islower() else "o"
    classes = sorted({kind(x) for x in alphabet})
    bits = math.log2(1 / len(classes))
    for a, b in zip(body, body[1:]):
        row = secrets.CHANGES[kind(a)]
        bits += math.log2(row[kind(b)] / sum(row[c] for c in classes))
    for x in body:
        same = [y for y in alphabet if kind(y) == kind(x)]
        weight = lambda y: secrets.FREQUENCY.get(y.lower(), 1.0)
        bits += math.log2((1 - secrets.EVEN) * weight(x) / sum(map(weight, same)) + secrets.EVEN / len(same))
    return name, -bits - n * math.log2(k), sum(a * a for a in z) < secrets.RANDOM_LIMIT


def value_of(text, span):
    s, k, e = span
    return ASSIGN.match(text, s)[2] if k == 0 else text[s:e]


def test_battery_and_control_against_brute_force(spark):
    """Every base value and run of sf0.01 and of made-up keys: each statistic, and Benjamini-Hochberg by its definition."""
    rng = random.Random(21)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    keys = "".join(map(chr, range(48, 58))) + secrets.UPPER + secrets.LOWER + "+/"
    texts += [f"key {''.join(rng.choice(keys) for _ in range(rng.choice([24, 40, 64])))} end" for _ in range(60)]
    texts += [f"name {x} end token = {x[:20]}" for x in ordinary_runs(rng, 300)] + [f"secret: {''.join(rng.choice(keys[:36] + '.=-') for _ in range(30))}" for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    given = {}
    for i, t in enumerate(texts):
        known = base_spans(t)
        for x in known:
            given[i, x] = value_of(t, x)
        for m in re.finditer(secrets.RUN, t):
            if not any(s < m.end() and e > m.start() for s, _, e in known):
                given[i, (m.start(), 3, m.end())] = m[0].rstrip("=")
    tested = {key: plain_battery(body) for key, body in given.items()}
    rows = secrets.battery(secrets.candidates(secrets.scanned(docs))).collect()
    got = {(r.doc_id, (r.s, r.kind, r.e)): (r.encoding, r.bits, r.random) for r in rows}
    assert got.keys() == tested.keys() and len(got) > 300
    for key, (name, bits, random_) in tested.items():
        assert got[key][0] == name and abs(got[key][1] - bits) < 1e-6 and got[key][2] == random_, given[key]
    found, families = set(), {}
    for key, (name, bits, _) in got.items():
        families.setdefault((key[1][1], name, int(math.log2(len(given[key])))), []).append((min(64, max(0, math.floor(bits))), key))
    for members in families.values():
        members.sort(key=lambda m: -m[0])
        last = max((j for j in range(1, len(members) + 1) if 2.0 ** -members[j - 1][0] <= j * secrets.RATE / len(members)), default=0)
        limit = members[last - 1][0] if last else 65
        found |= {key for level, key in members if level >= limit and got[key][2]}
    digest = {r.doc_id: r for r in secrets.digest(docs).collect()}
    for i in range(len(texts)):
        own = [key for key in got if key[0] == i]
        assert digest[i].n_random == sum(key in found for key in own if key[1][1] == 3)
        assert digest[i].n_base_random == sum(key in found for key in own if key[1][1] != 3) and digest[i].n_judged == sum(key[1][1] != 3 for key in own)
        p = [2.0 ** -max(0.0, got[key][1]) for key in own if key[1][1] != 3]
        assert (digest[i].base_p is None) == (not p) and (not p or abs(digest[i].base_p - min(p)) < 1e-12)
    assert sum(r.n_base_random for r in digest.values()) > 0 and sum(r.n_random for r in digest.values()) > 30


def test_redaction_keeps_rows(edges):
    edges = edges.withColumns({k: F.lit(1) for k in ("more", "a_id", "a_key", "tested", "n_judged", "x", "k", "kind")})
    out = secrets.redacted(edges)
    assert out.columns == edges.columns and out.count() == edges.count()
    assert "abcdefghijklmnop123" not in out.where("doc_id = 7").first().text


def sainte_lague(claims, seats):
    won = [0] * len(claims)
    heap = [(-c, i) for i, c in enumerate(claims) if c > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, i = heap[0]
        won[i] += 1
        heapq.heapreplace(heap, (-claims[i] / (2 * won[i] + 1), i))
    return won


def test_apportion(spark):
    rng = random.Random(3)
    for case in range(4):
        claims = [rng.choice([0, 1, 1, 5, 30, 900]) for _ in range(rng.randint(1, 9))]
        seats = rng.randint(0, 60)
        rows = spark.createDataFrame([(0, i, float(c), seats) for i, c in enumerate(claims)], "g int, i int, claim double, seats bigint")
        got = {r.i: r.got for r in mixing.apportion(rows, ["g"], [F.col("i")], "claim", "seats", "got").collect()}
        assert [got[i] for i in range(len(claims))] == sainte_lague(claims, seats), (claims, seats)


def targets(sizes):
    """Water filling by rounds."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def check_mix(docs, near):
    rows = docs.select("doc_id", "text", "source").collect()
    count = lambda t: len(re.findall("[^\\x20\\x09-\\x0D]+", t or ""))
    sizes, of = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + count(r.text)
        of[r.doc_id, count(r.text)] = r.source
    got = mixing.mix(docs).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(r.doc_id), count(r.text)) for r in rows)
    want, taken = targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        s = of[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= near + 0.02 * want[s], (s, taken[s], want[s])
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))


def test_mix(small, edges, empty):
    check_mix(small, 64)
    check_mix(edges, 64)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_mixed_rows_follow_counts(small):
    counted = mixing.mix(small).agg(F.sum("taken")).first()[0]
    words = mixing.mixed(small).agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert counted == words


def test_tool_calls(spark):
    call = lambda i, name, args, after=(): {"id": i, "name": name, "arguments": json.dumps(args), "after": list(after)}
    say = lambda *c: json.dumps({"tool_calls": list(c)})
    rows = [
        (1, 0, "assistant", say(call("a", "add", {"y": 2, "x": 1}, ["b"]), call("b", "add", {"x": 1, "y": "no"}), call("c", "nope", {}), call("p", "add", {"x": 1, "y": 1}, ["q"]), call("q", "add", {"x": 1, "y": 1}, ["p"]))),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "3"})),
        (1, 2, "tool", json.dumps({"tool_call_id": "zz", "content": "lost"})),
        (1, 3, "assistant", say(call("a", "add", {"x": 9, "y": 9}))),
        (2, 0, "user", None), (None, None, None, "x"), (2, 1, "assistant", "plain"),
    ]
    m = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    rule = {"type": "object", "properties": {"x": {"type": "integer"}, "y": {"type": "integer"}}, "required": ["x", "y"], "additionalProperties": False}
    calls, results = toolcalls.from_messages(m)
    got = {(r.call_id, r.turn): r for r in toolcalls.link(calls, results, {"add": rule}).collect()}
    a = got["a", 0]
    assert (a.status, a.valid, a.level) == ("linked", True, 1)
    assert a.canonical == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","result":"3"}'
    assert got["b", 0].level == 0 and got["b", 0].errors == "y: not integer" and got["b", 0].status == "unanswered"
    assert got["c", 0].errors == "no such tool" and got["p", 0].level is None and got["q", 0].level is None
    assert got["a", 3].status == "duplicate" and got["zz", 2].status == "orphan_result"
    assert toolcalls.conversation_links(m.limit(0)).count() == 0


def test_conversations(spark):
    m = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = m.collect()
    asks = {(r.conv_id, r.turn) for r in rows if r.role in ("user", "system")}
    answers = {(r.conv_id, r.turn - 1) for r in rows if r.role == "assistant"}
    got = toolcalls.conversation_links(m).collect()
    assert {(r.conv_id, r.turn) for r in got if r.status == "linked"} == asks & answers
    assert {(r.conv_id, int(r.call_id)) for r in got if r.status == "orphan_result"} == answers - asks
    assert len(got) == len(asks | answers)


def test_json_that_holds_no_calls_stays_dialogue(spark):
    calls = {"tool_calls": [{"id": "a", "name": "add", "arguments": "{}"}]}
    rows = [
        (1, 0, "user", json.dumps({"tool_call_id": "x"}) + " what is this?"), (1, 1, "assistant", "a result"),
        (2, 0, "system", json.dumps(calls)), (2, 1, "user", json.dumps(calls) + " and this?"), (2, 2, "assistant", json.dumps(calls)[:-9]),
        (3, 0, "user", "add"), (3, 1, "assistant", json.dumps(calls, indent=2)), (3, 2, "tool", json.dumps({"tool_call_id": "a", "content": "3"}, indent=2)),
        (4, 0, "user", "anything?"), (4, 1, "assistant", '{"tool_calls": []}'),
        (5, 0, "user", "and?"), (5, 1, "assistant", '{"tool_calls": "none"}'), (5, 2, "tool", '{"tool_call_id": null, "content": "lost"}'),
    ]
    m = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = sorted((r.conv_id, r.turn, r.call_id or "", r.status) for r in toolcalls.conversation_links(m).collect())
    assert got == [
        (1, 0, "0", "linked"), (2, 0, "0", "unanswered"), (2, 1, "1", "linked"),
        (3, 0, "0", "unanswered"), (3, 1, "a", "linked"), (4, 0, "0", "linked"), (5, 0, "0", "linked"), (5, 2, "", "orphan_result"),
    ]


def test_schemas_to_their_depth(spark):
    point = {"type": "object", "properties": {"x": {"type": "integer", "minimum": 0}}, "required": ["x"], "additionalProperties": False}
    rule = {"type": "object", "properties": {"at": point, "way": {"type": "array", "items": point}}, "required": ["at", "name"]}
    given = {
        "a": ({"at": {"x": 1}, "name": "n", "way": [{"x": 0}, {"x": 5}]}, ""), "b": ({"at": {"x": 1}}, "name: missing"), "c": ({"at": {}, "name": 1}, "at.x: missing"),
        "d": ({"at": {"x": -1, "y": 0}, "name": 1}, "at.x: minimum; at: unknown properties"), "e": ({"at": 3, "name": 1}, "at: not object"),
        "f": ({"at": {"x": 1}, "name": 1, "way": [{"x": 0}, {"x": "s"}, {"x": "t"}, 4]}, "way[].x: not integer; way[]: not object"),
        "g": ({"at": {"x": 1}, "name": 1, "way": []}, ""),
    }
    calls = spark.createDataFrame([(1, i, 0, k, "go", json.dumps(a), []) for i, (k, (a, _)) in enumerate(given.items())], "conv_id bigint, turn bigint, idx bigint, call_id string, name string, arguments string, after array<string>")
    results = spark.createDataFrame([], "conv_id bigint, turn bigint, call_id string, content string")
    got = {r.call_id: (r.errors, r.valid) for r in toolcalls.link(calls, results, {"go": rule}).collect()}
    assert got == {k: (e, e == "") for k, (_, e) in given.items()}
    for bad in ({"properties": {"x": {"const": 1}}}, {"properties": {"x": {"items": {"exclusiveMinimum": 0}}}}, {"oneOf": []}, {"properties": {"x": {"type": ["string", "null"]}}}):
        with pytest.raises(ValueError):
            toolcalls.errors(F.lit(None), bad)


def depths(after):
    """Longest way down from each call, None on or behind a cycle."""
    out, todo = {}, True
    while todo:
        todo = False
        for k, deps in after.items():
            if k not in out and all(d in out for d in deps):
                out[k] = max((out[d] + 1 for d in deps), default=0)
                todo = True
    return out


def test_levels_of_random_graphs(spark):
    """Chains, trees, joins, cycles and forward dependencies, several conversations at once (one without id)."""
    rng, rows, want = random.Random(8), [], {}
    for conv in (None, 1, 2, 3):
        n = 40
        names = [f"c{i}" for i in range(n)]
        rng.shuffle(names)
        after = {names[i]: sorted({names[rng.randrange(i)] for _ in range(rng.choice([0, 1, 1, 2]))}) if i else [] for i in range(n)}
        if conv == 1:  # one long chain, told from its end
            after = {names[i]: [names[i - 1]] if i else [] for i in range(n)}
        if conv == 2:
            after[names[5]] = [names[30]]
            after[names[30]] = [names[5]]
        places = list(range(n))
        rng.shuffle(places)
        rows += [(conv, places[i], 0, k, "go", "{}", after[k]) for i, k in enumerate(names)]
        want |= {(conv, k): depths(after).get(k) for k in names}
    calls = spark.createDataFrame(rows, "conv_id bigint, turn bigint, idx bigint, call_id string, name string, arguments string, after array<string>")
    calls = calls.unionByName(calls.limit(20))  # repeated rows count once
    results = spark.createDataFrame([], "conv_id bigint, turn bigint, call_id string, content string")
    got = {(r.conv_id, r.call_id): r.level for r in toolcalls.link(calls, results, {"go": {}}).collect()}
    assert got == want and any(v is None for v in want.values()) and max(v or 0 for v in want.values()) == 39


def test_conversation_levels_and_errors(spark):
    """Every answer's turn has the depth of its chain; null turns, repeated rows and extra columns change nothing."""
    rows = [(1, 0, "system", "be brief and kind to us"), (1, 1, "user", "what is the time now?"), (1, 2, "assistant", "noon"), (1, 3, "user", "no"), (1, 4, "assistant", "yes"), (1, 5, "user", "x " * 600), (2, None, "user", "a turn without its number"), (2, 0, None, "no role"), (None, 0, "user", "a talk without its number")]
    m = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"level": F.lit(5), "head": F.lit(1), "dep": F.lit("x"), "after": F.lit("y")})
    got = {(r.conv_id, r.turn): (r.level, r.status, r.errors) for r in toolcalls.conversation_links(m.unionByName(m)).collect()}
    assert got[1, 0] == (0, "unanswered", "") and got[1, 1] == (1, "linked", "") and got[1, 3] == (2, "linked", "words: minimum") and got[1, 5] == (3, "unanswered", "prompt: maxLength")
    assert got[None, 0][:2] == (0, "unanswered") and got[2, None][1] == "unanswered" and len(got) == 6


def test_mix_of_hot_rows(spark):
    """3000 repeated rows, 3000 without an id and one source with nearly all rows spread over many shards, and add up."""
    rows = spark.range(6400).selectExpr("CASE WHEN id < 3000 THEN 7L WHEN id < 6000 THEN NULL ELSE id END AS doc_id", "CASE WHEN id < 3000 THEN 'same words here' ELSE concat('w', id % 2000, ' and more') END AS text", "CASE WHEN id < 6300 THEN 'hot' WHEN id < 6350 THEN NULL ELSE 'b' END AS source", "id AS c_size", "1 AS c_start", "2 AS c_own", "3 AS c_parts", "4 AS place")
    placed = mixing._placed(mixing.sizes(rows), 8, 3, 64)
    assert placed.where("doc_id = 7").select("shard").distinct().count() >= 10 and placed.where("doc_id IS NULL").select("shard").distinct().count() >= 60
    want, taken = targets({"hot": 18900, None: 150, "b": 150}), {}
    got = mixing.mix(rows, docs_per_shard=64).collect()
    assert len(got) == 6400 and all(0 <= r.taken <= 3 * r["size"] for r in got)
    for r in got:
        taken[r.source_size, round(r.target)] = taken.get((r.source_size, round(r.target)), 0) + r.taken
    # a shard's quota is whole blocks and at most three times its words: here shards of the small sources have three words
    assert abs(sum(taken.values()) - sum(want.values())) < 100 and max(taken.values()) > 18_200
    mixed = mixing.mixed(rows, docs_per_shard=64)
    assert mixed.columns == rows.columns and mixed.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == sum(taken.values())


def test_mix_of_few_words(spark):
    docs = spark.createDataFrame([(1, "three words here", "a"), (2, "", "b"), (3, None, None)], "doc_id bigint, text string, source string")
    got = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    assert 0 < got[1] <= 9 and got[2] == got[3] == 0
