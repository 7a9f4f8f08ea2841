"""Secret scans: the patterns against a scanner without regular expressions, assignments against labelled texts."""

import hashlib
import random
import time

import pytest

from evispark.llm import queries, secret_scan

WORDS = ["password", "passwd", "secret", "token", "api_key", "apikey"]
VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def run_of(text, at, letters):
    end = at
    while end < len(text) and text[end] in letters:
        end += 1
    return end


def assign_at(text, at):
    """(end, length of the value) of the assignment that starts at ``at``, or None."""
    for word in WORDS:
        if "".join(c.lower() if c.isascii() else c for c in text[at : at + len(word)]) != word:
            continue
        i = at + len(word)
        i += text[i : i + 1] in ('"', "'") and i < len(text)
        i = run_of(text, i, " ")
        if text[i : i + 1] not in (":", "=") or i >= len(text):
            continue
        i = run_of(text, i + 1, " ")
        if text[i : i + 1] in ('"', "'") and i < len(text):
            i += 1
        end = run_of(text, i, VALUE)
        if end > i:
            return end, end - i
    return None


def plain(text):
    found, at = [], 0
    while at < len(text):
        hit = assign_at(text, at)
        if hit and hit[1] >= 6:
            found.append((at, 0, hit[0], "assign"))
        at = hit[0] if hit else at + 1
    for order, (kind, head, letters, least) in enumerate([("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), ("hex", "", set("0123456789abcdef"), 24)], 1):
        at = 0
        while at < len(text):
            end = run_of(text, at + len(head), letters) if text.startswith(head, at) else at
            if end > at + len(head):
                if end - at >= least:
                    found.append((at, order, end, kind))
                at = end
            else:
                at += 1
    return [f"{k}:{a}:{e}" for a, _, e, k in sorted(found)]


def made_up(seed, n=150):
    rng = random.Random(seed)
    parts = [*WORDS, "Password", "TOKEN", "API_Key", "apiKey", "ſecret", "toKen", "AKIA", "AKIAAKIA", "é", "😀", " ", "  ", "\n", "=", ":", '"', "'", "abc", "x9Zz+/", "0123456789abcdef", "deadbeef", "QWERTY123456", "==", "-", "`", "(", "+ ", "{", "}", "$", "<a>", "</a>"]
    return [None, "", *["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(n)]]


@pytest.mark.parametrize("seed", range(4))
def test_patterns_equal_a_plain_scanner(spark, tmp_path, seed):
    texts = made_up(seed)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "token=abcdef", None, None), (3, texts[3], "x", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, found string, spans int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_secrets(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = ("token=abcdef" if r.doc_id is None else texts[r.doc_id]) or ""
        want = plain(text)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
        assert [s for s in r.spans.split(",") if s.split(":")[0] in secret_scan.PATTERNS] == want


#: A text, and the literals that it must give beside the patterns, with their kinds.
CASES = [
    ('password = "p@ss w0rd!x9"', [("literal", "p@ss w0rd!x9")]),
    ('KEY = "k3Y$abc!9Zq"\nclient.secret_token = KEY', [("flow", "k3Y$abc!9Zq")]),
    ("a = 'Zx9!k' \"Lm8#q\"; b = a\npasswd_value = b", [("flow", "Zx9!k"), ("flow", "Lm8#q")]),
    ("const apiKey: string = `ab-12-CD_ef$$x`;", [("literal", "ab-12-CD_ef$$x")]),
    ('{"db_password": "hunter2!xyz", "note": "hello world 123!"}', [("literal", "hunter2!xyz")]),
    ("db:\n  passphrase: correct-H0rse-battery\n  user: bob\n", [("literal", "correct-H0rse-battery")]),
    ("private_key: |\n    MIIEv9$k2j3h4g5f6d7\n", [("literal", "MIIEv9$k2j3h4g5f6d7")]),
    ("BASE=Zq8#mN2$vB\nexport DB_CREDENTIALS=${BASE}\n", [("flow", "Zq8#mN2$vB")]),
    ("<Passphrase>s3cr3t!Pa55</Passphrase>", [("literal", "s3cr3t!Pa55")]),
    ("cfg['auth_token'] = 'zz91!kLm#0p'", [("literal", "zz91!kLm#0p")]),
    ("db = connect(pwd='Tr0ub4dor&3', user=\"bob\")", [("literal", "Tr0ub4dor&3")]),
    ('x := "Ab3$" + "9kZ!" + \'q7\'\nsigning_key := x', [("flow", "Ab3$"), ("flow", "9kZ!"), ("flow", "q7")]),
    ('credentials = """r4nd0m\nL!nes9"""', [("literal", "r4nd0m\nL!nes9")]),
    ("'client-secret' => 'Vb7%kQ1^zz'", [("literal", "Vb7%kQ1^zz")]),
    ('key = "Qm4@Xz7*"\nkey = "plain words here"\nbearer = key', []),
]
CLEAN = [
    'PASSWORD_HINT = "my d0g\'s name!1"', 'token_url = "https://a.b/c/d1E2f3"', 'pwd = "${DB_PWD}"', 'passphrase = os.environ["DB_PW"]', 'credentials = getenv("X9_y!aa")', "The secret: it rains.",
    'auth_token_expiry = "3600 s, 2 d4ys"', 'pwd = "<your pw 123!>"', 'passphrase = "xxxxxxxxxx"', 'credentials: none', 'title = "Zx9!kLm8#q"', 'bearer = "change_me_123!"', "time 12:45:30, ratio 3:4, see http://a.b:80/c?d=e", 'pwd = ""',
]


@pytest.mark.parametrize("text, want", CASES)
def test_assignments(text, want):
    assert [(f.kind, text[f.start : f.end]) for f in secret_scan.assignments(text)] == want
    # nothing changes in the midst of a text, but for the places
    longer = "Words before: ¿qué?\n" + text + "\nand after it.\n"
    assert [(f.kind, longer[f.start : f.end]) for f in secret_scan.assignments(longer)] == want


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts(text):
    assert secret_scan.assignments(text) == []


def test_spans_inside_patterns_are_left_out():
    inside, longer = "password='abcdefgh1'", "password='abcdef$%^ghi'"
    assert [f.kind for f in secret_scan.spans(inside)] == ["assign"]
    assert [(f.kind, f.start, f.end) for f in secret_scan.spans(longer)] == [("assign", 0, 16), ("literal", 10, 22)]


def test_operator_keeps_names_and_scores(spark):
    docs = spark.createDataFrame([(1, CASES[1][0], "z")], "doc_id long, text string, found string")
    [r] = secret_scan.find(docs).collect()
    assert [(f.kind, f.name) for f in r.found] == [("flow", "client.secret_token")] and 0.5 <= r.found[0].score <= 1
    assert secret_scan.find(docs.limit(0)).collect() == []


def test_time_grows_with_the_text():
    for part in ("a = ", 'a=a+"Xk9$lmn"\n', "password = (", "'''", "x['", '"', "a = b +\n", "<a>", "\\", "token:", "AKIA", "abcdef"):
        began = time.perf_counter()
        secret_scan.spans(part * (400_000 // len(part)))
        assert time.perf_counter() - began < 5, part
