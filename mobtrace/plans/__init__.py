"""Registered queries over the test tables, one module for each kind of operator."""
