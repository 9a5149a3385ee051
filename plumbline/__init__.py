"""Plumbline: analytics over coding-agent activity, written as lazy Spark DataFrame operators."""
