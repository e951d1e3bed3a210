"""Seeded generators of behaviour events and order change logs, for tests and demonstrations."""

from __future__ import annotations

import random
from collections.abc import Iterator
from datetime import datetime, timedelta
from decimal import Decimal

from .contracts import CHANNELS

#: Products that cost 8 % more from the middle of a run on.
REPRICED, RISE = (1001, 1021, 1076), Decimal("1.08")
FIRST, LAST = datetime(1900, 1, 1), datetime(9999, 12, 31, 23, 59, 59, 999000)

#: How many of the sessions that took a step take the next one.
STEP_RATES = {"cart": 0.62, "order": 0.58, "pay": 0.76}
#: Shares of independent events, and of orders.
EVENT_SHARES = {"view": 70, "cart": 15, "order": 10, "pay": 5}
CANCEL_SHARE, REFUND_SHARE, REFUND_PARTS = 0.15, 0.12, (Decimal("0.25"), Decimal("0.50"), Decimal("1.00"))
BAD_PRODUCTS, BAD_SHOPS = (9999, 8888, 0, -1), (99, 88, 0)


def _event(r: random.Random, i: int, session: str, user: int, product: int, shop: int, kind: str, channel: str, at: datetime, step: int) -> dict:
    return {
        "event_id": f"E{i:08d}", "session_id": session, "order_id": f"O{session}" if kind in ("order", "pay") else None, "event_sequence": step, "event_version": 1,
        "user_id": user, "product_id": product, "shop_id": shop, "event_type": kind, "channel": channel, "amount": f"{r.randint(100, 99999) / 100:.2f}",
        "event_time": at.strftime("%Y-%m-%d %H:%M:%S"),
    }


def journeys(n: int, seed: int = 0, start: datetime = datetime(2024, 1, 1), dirty: float = 0.02, disorder_s: int = 3) -> list[dict]:
    """Events of n shopping journeys: steps 1 to 20 s apart, some journeys with one spoilt event, arrival up to ``disorder_s`` late."""
    r, out, at = random.Random(seed), [], start
    for j in range(n):
        at += timedelta(seconds=r.randint(0, 4))
        t, session = at, f"S{j:07d}"
        user, product, shop, channel = r.randint(1, 5000), r.randint(1001, 1100), r.randint(1, 20), r.choice(CHANNELS)
        first = len(out)
        for step, kind in enumerate(("view", *STEP_RATES)):
            if step and r.random() >= STEP_RATES[kind]:
                break
            out.append((t, _event(r, len(out), session, user, product, shop, kind, channel, t, step + 1)))
            t += timedelta(seconds=r.randint(1, 20))
        if r.random() < dirty:
            r.choice(out[first:])[1].update(r.choice(({"event_id": None}, {"user_id": None}, {"event_type": "unknown"})))
    late = sorted(out, key=lambda x: x[0] + timedelta(seconds=r.uniform(0, disorder_s)))
    return [e for _, e in late]


def independent_events(n: int, seed: int = 0, start: datetime = datetime(2024, 1, 1), dirty: float = 0.03, misses: float = 0.01) -> list[dict]:
    """n unrelated events, with some spoilt ones and some dimension keys that don't exist."""
    r, out = random.Random(seed), []
    kinds, weights = zip(*EVENT_SHARES.items())
    for i in range(n):
        product = r.choice(BAD_PRODUCTS) if r.random() < misses else r.randint(1001, 1100)
        shop = r.choice(BAD_SHOPS) if r.random() < misses else r.randint(1, 20)
        e = _event(r, i, f"S{i:07d}", r.randint(1, 5000), product, shop, r.choices(kinds, weights)[0], r.choice(CHANNELS), start + timedelta(seconds=i), 1)
        if r.random() < dirty:
            e.update(r.choice(({"event_id": None}, {"user_id": None}, {"event_type": "unknown"}, {"event_time": "not-a-time"})))
        out.append(e)
    return out


def _catalogue(r: random.Random) -> dict[int, dict]:
    """The open version of each product."""
    return {
        p: {
            "product_id": p, "version_no": 1, "product_name": f"product {p}", "category_id": p % 10, "category_name": f"category {p % 10}", "price": Decimal(r.randint(500, 50000)) / 100,
            "effective_from": FIRST, "effective_to": LAST, "is_current": 1, "updated_at": FIRST,
        }
        for p in range(1001, 1101)
    }


def order_phases(n: int, seed: int = 0, start: datetime = datetime(2024, 1, 1)) -> Iterator[list[tuple[str, str, dict]]]:
    """Three committed phases of (entity, op, row): products and orders with lines, then payments or cancellations, then refunds.

    Lines have the catalogue price of their time; in the middle of the first phase some products change theirs.
    """
    r = random.Random(seed)
    products = _catalogue(r)
    orders, created, paid = [], [("dim_product_scd2", "c", dict(v)) for v in products.values()], []
    for i in range(n):
        at = start + timedelta(seconds=7 * i)
        if n >= 2 and i == n // 2:
            for p in REPRICED:
                old = products[p]
                created.append(("dim_product_scd2", "u", {**old, "effective_to": at, "is_current": 0, "updated_at": at}))
                products[p] = {**old, "version_no": old["version_no"] + 1, "price": (old["price"] * RISE).quantize(Decimal("0.01")), "effective_from": at, "updated_at": at}
                created.append(("dim_product_scd2", "c", dict(products[p])))
        lines = [(p, r.randint(1, 3), products[p]["price"]) for p in (r.randint(1001, 1100) for _ in range(r.randint(1, 3)))]
        order = {
            "order_id": f"O{i:06d}", "user_id": r.randint(1, 5000), "shop_id": r.randint(1, 20), "order_status": "CREATED", "channel": r.choice(CHANNELS),
            "order_amount": sum(q * p for _, q, p in lines), "promotion_code": r.choice((None, "NEW10", "VIP20", "SUMMER")), "create_time": at, "update_time": at, "version_no": 1,
        }
        orders.append(order)
        created.append(("order_info", "c", order))
        for k, (product, q, p) in enumerate(lines, 1):
            created.append(("order_detail", "c", {"detail_id": f"{order['order_id']}-D{k}", "order_id": order["order_id"], "product_id": product, "quantity": q, "unit_price": p, "detail_amount": q * p, "create_time": at, "update_time": at, "version_no": 1}))
    yield created
    second = []
    for o in orders:
        status = "CANCELLED" if r.random() < CANCEL_SHARE else "PAID"
        o = {**o, "order_status": status, "update_time": o["create_time"] + timedelta(minutes=5), "version_no": 2}
        second.append(("order_info", "u", o))
        if status == "PAID":
            paid.append(o)
            second.append(("payment_info", "c", {"payment_id": "P" + o["order_id"], "order_id": o["order_id"], "payment_status": "SUCCESS", "payment_method": r.choice(("alipay", "wechat_pay", "bank_card")), "payment_amount": o["order_amount"], "payment_time": o["update_time"], "update_time": o["update_time"], "version_no": 1}))
    yield second
    third = []
    for o in paid:
        if r.random() < REFUND_SHARE:
            o = {**o, "order_status": "REFUNDED", "update_time": o["update_time"] + timedelta(hours=1), "version_no": 3}
            amount = (o["order_amount"] * r.choice(REFUND_PARTS)).quantize(Decimal("0.01"))
            third.append(("order_info", "u", o))
            third.append(("refund_info", "c", {"refund_id": "R" + o["order_id"], "order_id": o["order_id"], "payment_id": "P" + o["order_id"], "refund_status": "SUCCESS", "refund_amount": amount, "refund_reason": None, "refund_time": o["update_time"], "update_time": o["update_time"], "version_no": 1}))
    yield third
