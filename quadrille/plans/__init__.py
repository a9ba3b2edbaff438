"""The registered queries: for each name a function (spark, folder of tables) -> DataFrame, and where SQL can state it, the SQL."""
