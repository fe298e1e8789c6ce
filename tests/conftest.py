import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from ledgerscope.session import get_session
    scratch = tempfile.mkdtemp(prefix="ledgerscope-tests-")
    s = get_session("local[4]", shuffle_partitions=4,
                    extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt")})
    yield s


T0 = dt.datetime(2024, 1, 1)


def day(d, h=0, m=0, s=0):
    return T0 + dt.timedelta(days=d, hours=h, minutes=m, seconds=s)


def make_txn(spark, rows):
    """rows: (transaction_id, customer_id, timestamp, amount[, transaction_type, counterparty_id, country, segment])."""
    from decimal import Decimal
    full = []
    for r in rows:
        r = list(r) + [None] * (8 - len(r))
        tid, cid, ts, amt, ttype, cp, country, seg = r
        full.append((tid, cid, f"ACC_{cid}", ts, Decimal(str(amt)), "USD", ttype or "deposit", "branch", cp,
                     country, seg))
    from ledgerscope.schemas import TXN
    return spark.createDataFrame(full, TXN)
