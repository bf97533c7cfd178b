"""Cheap tests that say where a dear one is needed: they may let too much through, never too little."""

import random
import time

import pyarrow as pa

from rinsework.operators import entities

PARTS = [
    *"aZ9 \n,.:-#/@$(+_", "12", "345", "6789", "98765", "٣٤٥٦", " ", " ", "\x1c", "é", "ſ", "K", "İ", "ı", "€", "INV", "ınvoıce", "Bill", "Bıll To", "RECEİPT", "usd", "uſd", "Rs", "inr", "İNR", "Mr.", "mrſ.", "Name", "Customer", "Contact\tPerson",
    "Anna Smith", "Bob", "x@y.co", "2024-03-", "1/2/24", "2024", "03", "Street", "St", "St.", "Kanpur", "Goa", "kerala", "san francisco", "ſF", "New York", "\n\n", "\n# ", "\nClient: ", "Road",
]


def test_screens_lose_no_entity():
    pick = random.Random(5)
    texts = ["".join(pick.choice(PARTS) for _ in range(pick.randint(1, 25))) for _ in range(6_000)] + ["", "x" * 50, "İNV: ABC", "Goa", "é Goa", "tel 98765 4321"]
    held = entities.may_hold(pa.array([*texts, None]))
    kinds = set()
    for i, t in enumerate(texts):
        whole = list(entities.find(t))
        assert list(entities.find(t, kinds=held.get(i, set()))) == whole, t
        kinds |= {x[0] for x in whole}
    assert kinds == {"InvoiceNo", "Email", "Phone", "Date", "Amount", "CustomerName", "PostalCode", "Address", "City", "State"} and len(texts) not in held


def test_letters_of_any_case():
    import re

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for c in "abcdefghijklmnopqrstuvwxyz":
        assert set(re.findall(c, every, re.I)) == {c, c.upper(), *entities.FOLDED.get(c, "")}


def test_texts_without_entities_cost_little(spark):
    """4 MB of words, in which nothing is found: every pattern over all of it would take about 8 seconds of one core, by its rate on check_s."""
    text = " ".join(["somme other wordes are writen herre"] * 30)
    df = spark.range(4000, numPartitions=1).selectExpr("cast(id as string) as doc_id", "1 as page", f"concat('{text}', id) as text")
    entities.extract(df.limit(10)).count()
    began = time.time()
    assert entities.extract(df).count() == 0
    assert time.time() - began < 3


DIGITS = ["1", "23", "456", "7890", "98765", "1234", "5678", "-", ".", " ", "(", ")", "+", "@", "a", "b.co", "x@y.org", "\n", "٣", "é", "_", "|", "[", "555-123-4567", "123-45-6789", "4111 1111 1111 1111"]


def test_screens_lose_no_personal_data(spark):
    from pyspark.sql import functions as F

    from rinsework.functions import pii

    pick = random.Random(6)
    rows = [(i, "".join(pick.choice(DIGITS) for _ in range(pick.randint(0, 20)))) for i in range(20_000)]
    df = spark.createDataFrame([*rows, (-1, None)], "i int, text string").persist()
    for kind, form in pii.CLASSES.items():
        missed = F.col("text").rlike(form if kind != "PHONE" else f"{form}|{pii.FULL_PHONE}") & ~(F.col("text").rlike(pii.HOLDS[kind]) & F.col("text").rlike(pii.HOLDS_ANY))
        assert df.filter(F.col("text").rlike(form)).count() > 100 and df.filter(missed).isEmpty()
    plain = F.col("text")
    for kind, form in [*list(pii.CLASSES.items())[:-1], ("PHONE", pii.FULL_PHONE)]:
        plain = F.regexp_replace(plain, form, f"[{kind}]")
    assert df.filter(~plain.eqNullSafe(pii.mask_class(F.col("text")))).isEmpty()


def test_texts_without_personal_data_cost_little(spark):
    """24 MB of words, in which nothing is found: each class took three passes of its pattern over all of it."""
    from rinsework.functions import pii

    text = " ".join(["somme other wordes are writen herre"] * 30)
    df = spark.range(24_000, numPartitions=1).selectExpr("id", f"concat('{text}', id % 10) as text")
    pii.mask_numbered(df.limit(10), "text").write.format("noop").mode("overwrite").save()
    began = time.time()
    pii.mask_numbered(df, "text").write.format("noop").mode("overwrite").save()
    assert time.time() - began < 12
