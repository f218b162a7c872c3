"""Readers, writers and generators of signals."""
from .signals import *  # noqa: F401,F403
