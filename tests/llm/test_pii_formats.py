import datetime
import re

import pytest

from lattica.llm import pii

DATES = {"25/12/2020": "%d/%m/%Y", "25-12-2020": "%d-%m-%Y", "12-25-2020": "%m-%d-%Y", "1.2.2020": "%d.%m.%Y", "25/1/2020": "%d/%m/%Y", "3/14/2020": "%m/%d/%Y", "1-12-2020": "%d-%m-%Y", "2020-1-31": "%Y-%m-%d", "2020.01.31": "%Y.%m.%d", "12.25.2020": "%m.%d.%Y"}
PHONES = {"+33 1 23 45 67 89": "+33", "+49 30 1234567": "+49", "+34 612 345 678": "+34", "+1 555 123 4567": "+1", "+44 (0)20 7946 0958": "+44 (0)", "+49 (30) 123-4567": "+49", "+33123456789": "+33", "00 33 1 23 45 67 89": "00 33", "+351.21.123.4567": "+351"}
shape = lambda s: re.sub(r"\d", "9", s)


@pytest.fixture(scope="module")
def replaced(spark):
    def run(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return [r for r in sorted(pii.pseudonymised(df).collect(), key=lambda r: r.doc_id)]

    return run


def test_dates_as_written(replaced):
    for (old, form), r in zip(DATES.items(), replaced([f"on {d}, it" for d in DATES])):
        new = r.text[3:-4]
        assert (r.n_date, shape(r.text)) == (1, f"on {shape(old)}, it") and new != old, (old, r.text)
        datetime.datetime.strptime(new, form)


def test_phones_with_country_codes(replaced):
    for (old, head), r in zip(PHONES.items(), replaced([f"call {p}." for p in PHONES])):
        assert (r.n_phone, shape(r.text)) == (1, f"call {shape(old)}.") and r.text.startswith(f"call {head}") and old not in r.text, (old, r.text)


def test_what_follows_a_phone_is_its_own(replaced):
    r = replaced(["+34 612 345 678 25/12/2020 +49 30 1234567 123-45-6789 +49 30 1234567 10.0.0.1 +49 30 1234567 4111 1111 1111 1111 1.2.2020-3.2.2020"])[0]
    assert (r.n_phone, r.n_date, r.n_ssn, r.n_ip, r.n_card) == (4, 3, 1, 1, 1)
    for gone in ("612 345", "25/12", "45-6789", "10.0.0.1", "1111 1111", "1.2.2020", "3.2.2020"):
        assert gone not in r.text


def test_what_is_no_date_or_phone_stays(replaced):
    texts = ["31.2.2020", "30/02/2020", "1.2.2020.4", "9.1.2.2020", "2020.1.2", "25/13/2020", "+1 23", "001 of 12", "3+4 5 6 7 8 9 10"]
    assert [r.text for r in replaced(texts)] == texts


def test_dates_of_a_form_are_permuted(replaced):
    """Every day of 13 to 31 in some years, day first with a slash, and every date with one digit of day and month."""
    days = [datetime.date(2019, 1, 1) + datetime.timedelta(k) for k in range(731)]
    for texts in ([f"{d:%d/%m/%Y}" for d in days if d.day > 12], [f"{d.day}.{d.month}.{d.year}" for d in days if d.day < 10 > d.month], [f"{d.day}-{d.month}-{d.year}" for d in days if d.day > 9 > d.month]):
        new = [r.text for r in replaced(texts)]
        assert len(set(new)) == len(texts) and [shape(x) for x in new] == [shape(x) for x in texts]
        for x in new:
            d, mo, y = map(int, re.split(r"[/.\-]", x))
            datetime.date(y, mo, d)
        if "/" in new[0]:
            assert all(int(x[:2]) > 12 for x in new)


def test_long_local_parts(spark):
    """An address is replaced whatever the length of its local part, and as a whole."""
    rows = [(1, "to " + "a1b" * 40 + "@mail.example.org now"), (2, "x" * 300), (3, "y" * 65 + "@b.de")]
    got = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].n_email for k in (1, 2, 3)] == [1, 0, 1]
    assert got[1].text.startswith("to ") and got[1].text.endswith("@mail.example.org now") and len(got[1].text) == len(rows[0][1])
    assert "a1ba1ba1b" not in got[1].text and "y" * 9 not in got[3].text and got[2].text == rows[1][1]
