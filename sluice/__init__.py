"""Sluice: temporal arbitration of shared capacity, written as PySpark dataflow.

Tables in, tables out.  Every public function takes and returns DataFrames;
Catalyst picks the physical plan.  ``operators`` holds the relational
operators, ``functions`` the scalar ones, ``sources`` what reads or derives
tables, ``plans`` whole rounds and the registered queries, ``streaming`` the
micro-batch form.
"""
