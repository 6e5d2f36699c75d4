"""vigilgrid: endpoint incident analytics and tabular onboarding as Spark DataFrame jobs."""

__version__ = "0.1.0"
