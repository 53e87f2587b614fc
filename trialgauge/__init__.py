"""trialgauge: clinical-operations analytics as Spark DataFrame jobs.

Layers, lowest first:

* ``functions``  column expressions and name rules, no I/O and no actions
* ``sources``    explicit schemas, readers and writers
* ``plans``      staging, distributed ordering, clinical views, features, scoring
* ``operators``  DataFrame-in / DataFrame-out analytics
* ``queries``    one registered query per inventory row, with its SQL oracle
"""
