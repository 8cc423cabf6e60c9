"""Guards around fitted objects, warnings, deprecations and the version report."""

from __future__ import annotations

import contextlib
import functools
import platform
import warnings
from collections.abc import Callable, Iterator
from importlib import metadata


class ModelFitWarning(UserWarning):
    """A candidate of an order search couldn't be fitted."""


class NotFittedError(ValueError, AttributeError):
    """Something was asked of an object before its fit()."""


def check_is_fitted(thing: object, attributes: str | list[str]) -> None:
    """NotFittedError if ``thing`` lacks an attribute that fit() leaves; TypeError if no names are given."""
    if not isinstance(attributes, (str, list, tuple)) or not attributes:
        raise TypeError("attributes must be a name or a list of names")
    names = [attributes] if isinstance(attributes, str) else attributes
    if not all(hasattr(thing, n) for n in names):
        raise NotFittedError(f"{type(thing).__name__} has not been fitted yet")


class delegated:  # noqa: N801  used as a decorator
    """A method that exists only while ``owner`` (an attribute, dots allowed) has a method of the same name."""

    def __init__(self, owner: str):
        self.owner = owner

    def __call__(self, method: Callable) -> delegated:
        self.method = method
        functools.update_wrapper(self, method)
        return self

    def __get__(self, thing: object, kind: type):
        if thing is None:
            return self.method
        target = functools.reduce(getattr, self.owner.split("."), thing)
        if not hasattr(target, self.method.__name__):
            raise AttributeError(f"{type(target).__name__} has no {self.method.__name__}")
        return self.method.__get__(thing, kind)


def deprecated(use: str, message: str = "") -> Callable[[Callable], Callable]:
    """Warns at each call that another function is to be used."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def call(*args, **kw):
            warnings.warn(f"{f.__name__} is deprecated, use {use}. {message}".rstrip(), DeprecationWarning, stacklevel=2)
            return f(*args, **kw)

        return call

    return wrap


@contextlib.contextmanager
def reraised(caught: type[Exception] | tuple, message: str, as_type: type[Exception] | None = None) -> Iterator[None]:
    """Errors of the block again, with a message of their own and perhaps another type; the first one is the cause."""
    try:
        yield
    except caught as e:
        raise (as_type or type(e))(message) from e


def versions() -> dict[str, str | None]:
    """Versions of Python, the system and the packages in use (None: not installed)."""
    out: dict[str, str | None] = {"python": platform.python_version(), "system": platform.platform()}
    for name in ("pyspark", "numpy", "pandas", "pyarrow"):
        try:
            out[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            out[name] = None
    return out


def show_versions() -> None:
    for name, version in versions().items():
        print(f"{name:>10}: {version}")
