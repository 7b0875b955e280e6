"""formloom: form and document review analytics as Spark DataFrame operators."""
