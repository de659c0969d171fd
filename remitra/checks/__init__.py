"""Test inputs drawn from the driver tables, and the SQL each operator is checked against."""
