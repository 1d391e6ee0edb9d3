import os
import sys
from datetime import datetime, timedelta, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskloom.schema import EVENT  # noqa: E402
from riskloom.session import build  # noqa: E402

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = build("local[4]", spark__driver__memory="6g", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
              spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def events(spark):
    """Build an event table from partial rows; `at` is minutes after T0."""
    def make(*rows):
        out = []
        for i, r in enumerate(rows):
            base = dict(txn_id=f"x{i:04d}", payer_vpa="a@bank", payee_vpa="shop@ybl", amount=100.0, txn_type="P2P",
                        initiation_mode="INTENT", device_id="d1", payer_bank="okaxis", payee_bank="ybl",
                        payer_account_age_days=365, label_is_fraud=False, label_typology="legit")
            r = dict(r)
            base["ts"] = T0 + timedelta(minutes=r.pop("at", 0))
            out.append(tuple({**base, **r}[n] for n in EVENT.names))
        return spark.createDataFrame(out, EVENT)
    return make
