import random

from pyspark.sql import functions as F

from ledgerloom.plans import card_views as cv


def transactions(spark, n=60):
    rng = random.Random(1)
    num = {**{f"C{i}": 5 for i in range(1, 15)}, **{f"D{i}": 40 for i in range(1, 16)}, **{f"V{i}": 3 for i in range(1, 340)},
           "card1": 6, "card2": 4, "card3": 2, "card5": 3, "addr1": 3, "addr2": 2, "dist1": 9, "dist2": 9}
    text = {"ProductCD": "WHC", "card4": "vm", "card6": "cd", "P_emaildomain": ["gmail.com", "mail.com"], "R_emaildomain": ["a.b", "gmail.com"],
            **{f"M{i}": "TF" for i in range(1, 10)}, "DeviceType": ["mobile", "desktop"], "DeviceInfo": ["SM-G9 Build/1", "Windows"],
            **{f"id_{i:02d}": ["x", "y"] for i in range(12, 39)}, "id_30": ["Windows 10", "iOS 11.1"], "id_31": ["chrome 63.0"], "id_33": ["10x20"], "id_34": ["match_status:2"]}
    num |= {f"id_{i:02d}": 7 for i in range(1, 12)}
    rows = [(i, i * 30000, float(rng.randint(1, 9000)) / 100, rng.randint(0, 1), "history" if i < n * 2 // 3 else "query",
             *[float(rng.randint(0, k)) if rng.random() > .15 else None for k in num.values()],
             *[rng.choice(v) if rng.random() > .15 else None for v in text.values()]) for i in range(n)]
    schema = "TransactionID long, TransactionDT long, TransactionAmt double, isFraud int, split string, " + ", ".join(
        [f"{c} double" for c in num] + [f"{c} string" for c in text])
    return spark.createDataFrame(rows, schema)


def test_family_and_view_sizes(spark):
    raw = transactions(spark)
    families, views = cv.build(raw)
    size = {k: len([c for c in t.columns if c not in (cv.ID, cv.LABEL, "split")]) for k, t in families.items()}
    assert size == {"base": 542, "profile": 78, "advanced": 75, "block": 396, "calendar": 139, "identity": 25, "behavior": 170, "amount": 6}
    assert {k: len(v) for k, v in views.items()} == {"vblock": 712, "structured": 1046}
    for t in families.values():
        assert t.count() == 60 and t.select(cv.ID).distinct().count() == 60
    d = cv.view(families, views["vblock"][300:330])
    assert d.count() == 60 and len(d.columns) == 31
    assert families["profile"].filter(F.col("user_txn_count" if "user_txn_count" in families["profile"].columns else "user_count") < 1).count() == 0
