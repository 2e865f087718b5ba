"""vigil: account-takeover detection as Spark DataFrame jobs.

Every operator is a function from DataFrame(s) to DataFrame; nothing
collects more than fitted statistics to the driver.
"""

__version__ = "0.1.0"
