"""Whole-mailbox runs composed from the operators."""
