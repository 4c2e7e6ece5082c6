"""The pattern language: syntax trees and the parser."""

from .ast import Pattern, capture_mode, fields, negation_normal
from .parser import parse

__all__ = ["Pattern", "capture_mode", "fields", "negation_normal", "parse"]
