"""The MySQL-compatible function library, as Spark SQL expressions by function name."""

from .registry import REGISTRY, UnsupportedFunction, call, install, render

__all__ = ["REGISTRY", "UnsupportedFunction", "call", "install", "render"]
