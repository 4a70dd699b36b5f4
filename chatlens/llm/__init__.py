"""Training-data pipeline operators over a `documents` table.

One module per operator; `queries` registers them. Nothing outside this
package imports it.
"""
