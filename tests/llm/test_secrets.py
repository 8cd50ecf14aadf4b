import hashlib
import random
import re
import time

from premia.llm import secrets

SCHEMA = "doc_id bigint, text string, found string, n_chars bigint, spans string"
PARTS = ["password", "PassWord", "token", "secret", "api_key", "apikey", "=", ":", " ", "'", '"',
         "abcdef", "0123456789abcdef", "AKIA", "ABCDEF12", "é", "\n", ",", "x", "ghp_", "eyJ", ".",
         "deadbeef", "a", "-----BEGIN RSA PRIVATE KEY-----", "AIza", "xoxb-", "\U0001F600"]


def brute(text):
    return sorted((m.start(), n, m.end()) for n, rule in enumerate(secrets.RULES)
                  for m in re.finditer(rule.full, text or "") if len(m[rule.group]) >= rule.least)


def random_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_scan_equals_regular_expressions():
    automaton = secrets.compile_rules()
    texts = random_texts(8000) + ["f" * 9000, "password=" * 700, "", "x, " * 4000 + "AKIA" + "Z" * 16]
    assert secrets.scan_texts(texts, automaton) == [brute(t) for t in texts]


def test_automaton_is_minimal_and_exact():
    rules = (secrets.Rule("a", "ab+c|abd", "ab+c|abd"), secrets.Rule("b", "(?i:x)[0-3]{2}y?",
                                                                    "(?i:x)[0-3]{2}"))
    automaton = secrets.compile_rules(rules)
    width = automaton.byte_class.max() + 1
    # start, a, ab, abb+, x, x0, and one accepting state for each of what may go on after it
    assert len(automaton.table) // width == 7
    for text, end in (("zabbbc", 5), ("aabd", 3), ("X31y", 2)):
        state, hits = 0, []
        for k, b in enumerate(text.encode()):
            state = automaton.table[state + automaton.byte_class[b]]
            hits += [k] if state >= automaton.accepting else []
        assert hits == [end]


def test_spans_and_redaction(spark):
    texts = random_texts(300, 8) + [None, "", "key token=abcdef123 and token=abcdef123"] * 2
    docs = spark.createDataFrame([(k // 2 if k else None, t, "x", len(t or ""), "y")
                                  for k, t in enumerate(texts)], SCHEMA)
    found = secrets.secret_spans(docs).collect()
    assert len(found) == len(texts)
    line = lambda spans: ",".join(f"{secrets.RULES[n].kind}:{s}:{e}" for s, n, e in spans)
    for row, text in zip(found, texts):
        spans = brute(text)
        assert row.spans == line(spans)
        assert row.base_sha256 == hashlib.sha256(
            line([s for s in spans if secrets.RULES[s[1]].base]).encode()).hexdigest()
    clean = secrets.redact(docs)
    assert clean.schema == docs.schema
    for row, text in zip(clean.collect(), texts):
        assert row.n_chars == len(row.text or "")
        if not brute(text):
            assert row.text == text
        else:
            kept = [True] * len(text)
            for s, _, e in brute(text):
                kept[s:e] = [False] * (e - s)
            assert row.text.replace("[secret]", "") == "".join(
                c for c, k in zip(text, kept) if k)
    assert secrets.secret_spans(docs.limit(0)).count() == 0


def test_redact_leaves_no_key_line(spark):
    rng = random.Random(9)
    body = ["".join(rng.choices("ABCXYZabcxyz0189+/", k=64)) for _ in range(6)] + ["q1W2e3=="]
    plain, short = body[:-1], body[:3] + ["q1W2e3"]
    head, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    marks = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0F", ""]
    keys = [mark.join([head, *lines, *last]) for mark in ("\n", "\r\n", "\n    ", "\n> ", "\\n", "\n\n", " ")
            for lines in (body, plain) for last in ([end], [])]
    keys += ["\n".join([head, *marks, *body, *last]) for last in ([end], [])]
    keys += ["\n".join([head, *short]), head + "\n" + body[0] + "\u00e9(x),\n" + body[1] + "\n" + end]
    texts = [f"Texte \u00e9, first (line)\n{key}\nthe words after it, stay" for key in keys]
    texts += [f'{{"key": "{key}"}}' for key in keys] + ["\n".join([keys[0], "between", keys[2]])]
    docs = spark.createDataFrame([(k, t, "x", len(t), "y") for k, t in enumerate(texts)], SCHEMA)
    for row in secrets.redact(docs).collect():
        assert not any(line in row.text for line in (*body, "q1W2e3", "PRIVATE KEY", "DEK-Info")), row
        assert row.n_chars == len(row.text)
        if row.doc_id < len(keys):
            assert row.text.startswith("Texte \u00e9, first (line)\n[secret]")
            assert row.text.endswith("\nthe words after it, stay")
    assert secrets.scan_texts(texts, secrets.compile_rules()) == [brute(t) for t in texts]


def test_open_keys_take_time_in_proportion():
    texts = [f"{head} x - " * 20_000 for head in ("-----BEGIN PRIVATE KEY-----", "PRIVATE KEY-----")]
    texts.append("-----BEGIN PRIVATE KEY-----" + "\nA: b" * 100_000 + "\n > " * 100_000)
    begun = time.process_time()
    found = secrets.scan_texts(texts, secrets.compile_rules())
    assert [len(f) for f in found] == [20_000, 0, 1]
    assert time.process_time() - begun < 20


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = secrets.secret_spans(docs).collect()
    assert len(found) == len(texts)
    for row in found:
        assert [(s.start, s.end) for s in row.found] == [(s, e) for s, _, e in brute(texts[row.doc_id])]
