"""Small books for tests."""

import datetime as dt
from decimal import Decimal as D
from types import SimpleNamespace

from tallyforge.plans import presets

DAY = dt.datetime(2024, 6, 1)
CLASS = {code: i for i, code, *_ in presets.CLASSIFICATIONS}
KIND = {code: i for i, (code, *_) in enumerate(presets.JOURNAL_TYPES, 1)}


def entries(spark, rows):
    """Rows (journal, holder, currency, class code, side, amount[, effective day offset]); ids in order."""
    out = []
    for i, r in enumerate(rows, 1):
        journal, holder, currency, code, side, amount, *rest = r
        when = DAY + dt.timedelta(days=rest[0] if rest else 0)
        out.append((i, journal, holder, currency, CLASS[code], side, D(str(amount)), when, DAY))
    return presets.literal(spark, out, "entries")


def journals(spark, rows):
    """Rows (id, type code[, reversal_of[, memo[, total]]])."""
    out = []
    for r in rows:
        i, kind, of, memo, amount = (*r, *(None, "", 0)[len(r) - 2 :])
        out.append((i, f"jrn-{i}", KIND[kind], f"key-{i}", D(str(amount)), D(str(amount)), memo, 0, "test", of, 0, DAY, DAY))
    return presets.literal(spark, out, "journals")


def currencies(spark):
    return presets.literal(spark, [(1, "cur-1", "USD", "Dollar", True, 2), (2, "cur-2", "EUR", "Euro", True, 2)], "currencies")


def reservations(spark, rows):
    """Rows (id, holder, currency, reserved, settled, status)."""
    out = [(i, f"rsv-{i}", h, c, D(str(a)), D(str(s)), st, None, f"rk-{i}", DAY + dt.timedelta(days=1), DAY) for i, h, c, a, s, st in rows]
    return presets.literal(spark, out, "reservations")


def dims(spark):
    return SimpleNamespace(classifications=presets.classifications(spark), journal_types=presets.journal_types(spark), templates=presets.templates(spark), lifecycles=presets.lifecycles(spark), currencies=currencies(spark))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
