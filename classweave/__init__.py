"""Binary classification of tables on Spark: profile, clean, learn, score."""

from classweave.spec import EMPLOYEE, FeatureSpec, employee_schema

__all__ = ["EMPLOYEE", "FeatureSpec", "employee_schema"]
