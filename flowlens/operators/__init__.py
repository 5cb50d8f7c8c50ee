"""DataFrame transformations. Unless a function fits a model or says otherwise, it
only extends the plan and runs no job."""
