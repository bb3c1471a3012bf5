"""Pseudonyms against the same network written in Python."""

import datetime as dt
import hashlib
import random
import re

from tongueloom.llm.pseudonyms import pseudonymise

KEY = "k'1"


def feistel(kind, a, b, a_mod, b_mod):
    for r in range(1, 9):
        x, mod = (b, a_mod) if r % 2 else (a, b_mod)
        n = int(hashlib.sha256(f"{KEY}|{kind}|{a_mod}|{r}|{x}".encode()).hexdigest()[:15], 16) % mod
        a, b = ((a + n) % a_mod, b) if r % 2 else (a, (b + n) % b_mod)
    return a, b


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


def put(m, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in m)


def card(m):
    d = re.sub("[^0-9]", "", m)
    if not luhn(d):
        return m
    n = len(d) - 2
    u, v = n // 2, n - n // 2
    a, b = feistel("card", int(d[1:1 + u]), int(d[1 + u:1 + n]), 10 ** u, 10 ** v)
    y = d[0] + str(a).zfill(u) + str(b).zfill(v)
    return put(m, next(y + str(c) for c in range(10) if luhn(y + str(c))))


def phone(m):
    d = re.sub("[^0-9]", "", m)
    a, b = feistel("phone", int(d[-10:-5]), int(d[-5:]), 100000, 100000)
    return put(m, d[:-10] + str(a).zfill(5) + str(b).zfill(5))


def ip(m):
    o = [int(x) for x in m.split(".")]
    if max(o) > 255:
        return m
    a, b = feistel("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def ssn(m):
    area, group, serial = int(m[:3]), int(m[4:6]), int(m[7:])
    if not (1 <= area <= 899 and area != 666 and group and serial):
        return m
    a, b = feistel("ssn", (area - (2 if area > 666 else 1)) * 99 + group - 1, serial - 1, 88902, 9999)
    return f"{a // 99 + (2 if a // 99 >= 665 else 1):03}-{a % 99 + 1:02}-{b + 1:04}"


def date(m):
    form = "%Y-%m-%d" if m[4] == "-" else "%Y/%m/%d" if m[4] == "/" else "%d.%m.%Y" if "." in m else "%m/%d/%Y"
    try:
        day = dt.datetime.strptime(m, form).date()
    except ValueError:
        return m
    d = (day - dt.date(1700, 1, 1)).days
    if not 0 <= d <= 146096:
        return m
    a, b = feistel("date", d // 773, d % 773, 189, 773)
    return (dt.date(1700, 1, 1) + dt.timedelta(a * 773 + b)).strftime(form)


VALUES = {
    date: ["2024-01-31", "1999/12/01", "31.01.2024", "12/25/1987", "1700-01-01", "2099-12-31"],
    ip: ["70.123.182.155", "0.0.0.0", "255.255.255.255"],
    ssn: ["123-45-6789", "001-01-0001", "899-99-9999", "667-12-3456"],
    phone: ["+1 (269) 555-3296", "(988) 555-2485", "319-555-5132", "+44 319.555-5132"],
    card: ["4041894974608795", "4111 1111 1111 1111", "3782-822463-10005", "4222222222222"],
}
INVALID = ["2024-02-30", "1.2.3.999", "000-12-3456", "666-12-3456", "4041894974608796", "1234567", "12", "v4041894974608795", "1.2.3.4.5", "2101-01-01"]


def test_values_and_texts(docs_of):
    rnd, rows, want = random.Random(4), [], {}
    valid = [(f, v) for f, vs in VALUES.items() for v in vs]
    for i in range(60):
        picks = [rnd.choice(valid) if rnd.random() < 0.7 else (str, rnd.choice(INVALID)) for _ in range(rnd.randint(0, 6))]
        text, masked = "", ""
        for f, v in picks:
            lead = rnd.choice(["Call ", "é (", "\n", "id: ", " "])
            text += f"{lead}{v}, "
            masked += f"{lead}{f(v)}, "
        rows.append((i, text))
        want[i] = (masked, [f(v) for f, v in picks if f is not str])
    got = {r.doc_id: r for r in pseudonymise(docs_of(rows).selectExpr("*", "1 as found"), KEY).collect()}
    for i, _ in rows:
        assert (got[i].text, [v.pseudonym for v in got[i].found]) == want[i]


def test_different_values_stay_different(docs_of):
    days = [(k, (dt.date(2000, 1, 1) + dt.timedelta(k)).isoformat()) for k in range(3000)]
    cards = [x for k in range(9000) if luhn(x := str(4000000000000 + 37 * k))]
    texts = [r.text for r in pseudonymise(docs_of(days + [(9000 + k, c) for k, c in enumerate(cards)]), KEY).collect()]
    assert len(set(texts)) == len(texts)
    assert all(luhn(t) for t in texts if "-" not in t)


def test_nulls_empty_long_and_plan(docs_of):
    long = "w 2024-01-31 " * 20_000
    df = pseudonymise(docs_of([(1, None), (2, ""), (3, long), (None, "2024-01-31"), (3, long), (4, "2024-01-31")]), KEY)
    rows = df.collect()
    assert [r.text for r in rows][:2] == [None, ""] and rows[0].found == [] and rows[1].found == []
    assert rows[2] == rows[4] and len(rows[2].found) == 20_000 and rows[3].text == rows[5].text == rows[2].found[0].pseudonym
    assert pseudonymise(docs_of([]), KEY).count() == 0
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())
