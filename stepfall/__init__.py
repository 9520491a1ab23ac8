"""Funnel root-cause analytics on Spark.

Every public function takes DataFrames and returns a lazy DataFrame; none runs an action
or keeps a session.  ``instance_id`` (the case) is an ordinary key, so one plan serves all
cases at once.
"""
