"""Registered queries, grouped by family."""


def load_all():
    import importlib
    import pkgutil

    from heliograde.plans.registry import ORACLES, QUERIES

    for m in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{m}")
    return dict(QUERIES), dict(ORACLES)
