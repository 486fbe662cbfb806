"""Registered queries by family; importing a module registers its queries."""
import importlib
import pkgutil


def load_all() -> None:
    for m in sorted(x.name for x in pkgutil.iter_modules(__path__)):
        if m not in ("registry", "views"):
            importlib.import_module(f"{__name__}.{m}")
