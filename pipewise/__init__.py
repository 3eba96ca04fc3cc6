"""pipewise: DataFrame operators for looking after batch jobs at scale.

functions   column expressions (no DataFrame in sight)
operators   DataFrame -> DataFrame transformations
sources     readers and writers
plans       operators composed into the daily, decision and validation plans
streaming   incremental landing of run records
"""
