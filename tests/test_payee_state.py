"""The payee processor without a stream."""

import random

import pandas as pd
from test_state import Store

from riskloom.streaming import payee_state


def test_payers_of_a_payee_cost_calls_per_list():
    r = random.Random(3)
    rows = [dict(txn_id=f"t{i:05d}", us=i // 3, payer_vpa=r.choice([None, *[f"u{j}" for j in range(2000)]]), amount=r.randrange(1000) / 4,
                 txn_type=r.choice(["P2M", "P2P"])) for i in range(6000)]
    store, payee = Store(), payee_state.PayeeHistory()
    payee.init(store)
    got = {}
    for begin in (0, 3000):
        batch = pd.DataFrame(rows[begin:begin + 3000])
        batch["slot"] = [hash(x) % payee_state.SLOTS for x in batch["payer_vpa"]]
        store.calls = 0
        for out in payee.handleInputRows(("m",), iter([batch.sample(frac=1, random_state=1)]), None):
            got |= {x["txn_id"]: x for x in out.to_dict("records")}
        assert store.calls <= 2 * payee_state.SLOTS + 3
    for x in rows[::37]:
        past = [y for y in rows if y["us"] < x["us"]]
        f = got[x["txn_id"]]
        assert (f["payee_n"], f["payee_payers"], f["payee_p2m"], f["payee_sum"], f["late"]) == (
            len(past), len({y["payer_vpa"] for y in past}), sum(y["txn_type"] == "P2M" for y in past), sum(y["amount"] for y in past), False)
        assert pd.isna(f["payee_first_us"]) if not past else f["payee_first_us"] == 0
    again = pd.DataFrame([dict(rows[0], txn_id="z", slot=0)])
    (out,) = payee.handleInputRows(("m",), iter([again]), None)
    assert out["late"].tolist() == [True] and out["payee_n"].tolist() == [6000]
